"""DuckDB inside Arrow partitions: one in-process connection a task, one SQL statement a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows handed to one SQL statement; a batch of very long texts is thus cut before it is folded.
SLICE = 2000


def map_sql(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """``df`` with every Arrow batch replaced by the result of ``sql`` over the batch, named ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB"})
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                con.register("batch", pa.Table.from_batches([whole.slice(at, SLICE)]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)
