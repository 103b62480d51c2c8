"""Sinks under Spark's commit protocol: tables by book, chunk files, JSON lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def table(df: DataFrame, path: str, overwrite: bool = False, by: str = "book_id") -> None:
    """A table partitioned by book; without ``overwrite`` an existing one is an error. Old files do not stay."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(by).parquet(path)


def lines(df: DataFrame, path: str, keys: list[str], order: list[str], line: str = "line") -> None:
    """Texts of one line a row, in files whose names and contents follow the order; a book of any size spreads over many of them."""
    df.repartitionByRange(*(F.col(c) for c in (*keys, *order))).sortWithinPartitions(*keys, *order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, appended; an empty table writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").json(path)


def json_documents(df: DataFrame, path: str) -> None:
    """Rows as JSON texts, committed as a whole."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def voices(df: DataFrame, path: str) -> None:
    """Voices as JSON texts, one folder a voice; fields that are null are left out."""
    text = F.to_json(F.struct("name", "ref_audio", "ref_text", "language", "gender"))
    df.select(F.col("name").alias("voice"), text.alias("value")).write.mode("overwrite").partitionBy("voice").text(path)


def chunk_files(chunks: DataFrame, path: str, overwrite: bool = True) -> None:
    """Chunk texts by chapter, in order."""
    rows = chunks.select("chapter_id", F.format_string("%06d", "chunk_idx").alias("file"), "text")
    rows.repartition("chapter_id").sortWithinPartitions("chapter_id", "file").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("chapter_id").json(path)
