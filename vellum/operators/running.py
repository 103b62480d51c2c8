"""Running sums and maxima over an order within a key, where a key may hold a third of all rows.

Rows are range-partitioned by key and order, so a large key spreads over many partitions; within each share of a key
a window runs, and what stands before the share is the total of the shares before it, one row a share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vellum.session import written


def shared(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written once, range-partitioned by key and order, with ``_share``, the partition each row is in."""
    return written(df.repartitionByRange(*(F.col(c) for c in (*keys, *order))).withColumn("_share", F.spark_partition_id()), "shares")


def before_each(shares: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
    """``shares`` with, for each name, the sum or maximum over the rows before each row (0 and null before the first)."""
    values = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxima.items()}
    x = shares.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    before = Window.partitionBy(*keys, "_share").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "_share").agg(*(f(f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_share"])]
    offsets = totals.select(*keyed, *(f(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, (f, _) in values.items()))
    local = x.withColumns({f"_l_{n}": f(f"_v_{n}").over(before) for n, (f, _) in values.items()})
    on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_share"])))
    out = {n: F.coalesce(f"_o_{n}", F.lit(0)) + F.coalesce(f"_l_{n}", F.lit(0)) for n in sums} | {n: F.greatest(f"_o_{n}", f"_l_{n}") for n in maxima}
    return local.join(offsets, on, "left").select(*(c for c in shares.columns if c not in out), *(c.alias(n) for n, c in out.items()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each name, the sum or maximum over the rows before each row (0 and null before the first).

    The shares are written when this is called. Rows that tie in the order stay in one share; their order among each other is that of the window's sort."""
    return before_each(shared(df, keys, order), keys, order, sums or {}, maxima or {}).drop("_share")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "_n") -> DataFrame:
    """``df`` with the place of each row within its key, from 1; give it narrow rows."""
    return running(df, keys, order, {name: F.lit(1)}).withColumn(name, F.col(name) + 1)


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``keys, start, end``: intervals that touch or overlap as one, from one written table."""
    shares = shared(df.select(*keys, start, end), keys, [start, end])
    reached = before_each(shares, keys, [start, end], {}, {"_reached": F.col(end)})
    opened = reached.withColumn("_new", F.coalesce((F.col(start) > F.col("_reached")).cast("int"), F.lit(1)))
    placed = before_each(opened, keys, [start, end], {"_before": F.col("_new")}, {}).withColumn("_island", F.col("_before") + F.col("_new"))
    return placed.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
