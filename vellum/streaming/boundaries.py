"""The boundary log as a stream: cleaned on arrival, late and repeated entries handled by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from vellum import schemas
from vellum.functions.fields import log_entry_fields, log_entry_valid
from vellum.operators.stats import boundary_filter


def cleaned(log: DataFrame) -> DataFrame:
    """Entries that have what they need, every field within its bounds; works on a batch and on a stream."""
    return log.where(log_entry_valid()).withColumns(log_entry_fields())


def arriving(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines as they are added to a folder."""
    return spark.readStream.schema(schemas.BOUNDARY_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def once_each(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Exact repetitions dropped, as far back as the watermark on the capture time reaches."""
    timed = log.withColumn("captured", F.timestamp_seconds("captured_unix")).withWatermark("captured", late)
    return timed.dropDuplicatesWithinWatermark([c for c in log.columns if c != "logged_unix"])


def by_window(log: DataFrame, width: str = "1 hour", trigger: str = "gapless") -> DataFrame:
    """Filtered boundaries by window and book: counts, mean delta and latency; partial sums, so a hot book is no hot task."""
    timed = log if "captured" in log.columns else log.withColumn("captured", F.timestamp_seconds("captured_unix"))
    return boundary_filter(timed, trigger).groupBy(F.window("captured", width), "book_id").agg(
        F.count("*").alias("n"), F.count("output_latency_ms").alias("with_latency"), F.avg("delta_ms").alias("mean_delta_ms"), F.avg("corrected_ms").alias("mean_corrected_ms")
    )


def sink(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to a table of JSON lines, exactly once by its checkpoint."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
