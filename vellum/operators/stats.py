"""Series statistics and the boundary report: one filter and conditional aggregates, no row leaves the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RATE = (0.95, 1.05)
DELTA = (-5000.0, 5000.0)
LATENCY = (0.0, 5000.0)
SERIES = {"delta": "delta_ms", "latency": "output_latency_ms", "fixed": "corrected_ms"}
QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def percentile(values: Column, q: float) -> Column:
    """The value at the floor of (n - 1) q of an ascending array: neither interpolated nor the next one up."""
    return F.try_element_at(values, (F.floor((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def series(values: Column) -> Column:
    """n, min, p10 to p90, max and mean of an array of numbers, null when it is empty.

    A percentile of exactly 0 is replaced by the least value, or from p75 on by the greatest, as the reports have it."""
    v = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    low, high = F.try_element_at(v, F.lit(1)), F.try_element_at(v, F.lit(-1))

    def at(name: str, q: float) -> Column:
        p = percentile(v, q)
        return F.round(F.when(p == 0, low if q <= 0.5 else high).otherwise(p), 3).alias(name)

    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    fields = [F.size(v).alias("n"), F.round(low, 3).alias("min"), *(at(k, q) for k, q in QUANTILES.items()), F.round(high, 3).alias("max"), F.round(mean, 3).alias("mean")]
    return F.when(F.size(v) > 0, F.struct(*fields))


def exact_percentile(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float] = QUANTILES, width: float = 0.01) -> DataFrame:
    """The same statistics for groups of any size: (keys, n, min, p10 to p90, max, mean), unrounded.

    Values are counted by the cells of a grid, with partial sums; ranks are found by a window over the cells of a group, whose number
    the bounds of the values and the width limit, never over its rows. Only the few cells that a rank falls in and that hold different values
    are looked at again."""
    if not keys:
        return exact_percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, quantiles, width).drop("_all")
    x = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_c", F.floor(F.col("_v") / width))
    cells = x.groupBy(*keys, "_c").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_v").alias("_s"))
    group = Window.partitionBy(*keys).orderBy("_c")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = cells.withColumns({
        "_upto": F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("_n").over(whole), "min": F.min("_low").over(whole),
        "max": F.max("_high").over(whole), "mean": F.sum("_s").over(whole) / F.sum("_n").over(whole),
    })
    ranks = F.array(*(F.struct(F.lit(k).alias("q"), (F.floor((F.col("n") - 1) * F.lit(q)) - (F.col("_upto") - F.col("_n"))).alias("rank")) for k, q in quantiles.items()))
    hits = placed.select("*", F.explode(F.filter(ranks, lambda r: (r["rank"] >= 0) & (r["rank"] < F.col("_n")))).alias("_q"))
    mixed = hits.where("_low < _high").select(*keys, "_c", F.col("_q.q").alias("q"), F.col("_q.rank").alias("rank"))
    counts = x.join(mixed.select(*keys, "_c").distinct(), [*keys, "_c"], "left_semi").groupBy(*keys, "_c", "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = mixed.join(counts.withColumn("_to", upto), [*keys, "_c"]).where((F.col("rank") < F.col("_to")) & (F.col("rank") >= F.col("_to") - F.col("_m"))).select(*keys, "q", "_v")
    even = hits.select(*keys, F.col("_q.q").alias("q"), F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_v"), "n", "min", "max", "mean")
    both = even.unionByName(found, allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *(F.max(c).alias(c) for c in ("n", "min", "max", "mean")), *(F.max(F.when(F.col("q") == k, F.col("_v"))).alias(k) for k in quantiles)
    )


def as_series(prefix: str) -> Column:
    """The columns of ``exact_percentile`` as one rounded struct, with percentiles of exactly 0 replaced as in ``series``."""
    c = lambda k: F.col(f"{prefix}.{k}")
    at = [F.round(F.when(c(k) == 0, c("min") if q <= 0.5 else c("max")).otherwise(c(k)), 3).alias(k) for k, q in QUANTILES.items()]
    return F.when(c("n").isNotNull(), F.struct(c("n"), F.round(c("min"), 3).alias("min"), *at, F.round(c("max"), 3).alias("max"), F.round(c("mean"), 3).alias("mean")))


def tells_of_pad(trigger: str) -> Column:
    """Whether an entry tells of the pad: the trigger, preloaded, at about normal speed, within bounds."""
    return (F.col("trigger_kind") == trigger) & F.col("preloaded") & F.col("playback_rate").between(*RATE) & F.col("delta_ms").between(*DELTA)


def boundary_filter(log: DataFrame, trigger: str = "gapless") -> DataFrame:
    """The entries that tell of the pad; latency null when out of bounds."""
    latency = F.when(F.col("output_latency_ms").between(*LATENCY), F.col("output_latency_ms"))
    kept = log.where(tells_of_pad(trigger))
    return kept.withColumns({"output_latency_ms": latency, "corrected_ms": F.col("delta_ms") + latency})


def boundary_report(log: DataFrame, keys: list[str] | None = None, least: int = 200, trigger: str = "gapless") -> DataFrame:
    """Counts, coverage, pads, three series and the recommended change of the pad, for the whole log or each key.

    Nothing of a group is held as rows: pads are distinct values, percentiles come from counts over grids."""
    keys = list(keys or [])
    own = keys or ["_all"]
    log = log if keys else log.withColumn("_all", F.lit(0))
    kept = boundary_filter(log, trigger)
    tells = tells_of_pad(trigger)
    late = tells & F.col("output_latency_ms").between(*LATENCY)
    out = log.groupBy(*own).agg(
        F.count("*").alias("samples_total"), F.count_if(tells).alias("filtered"), F.count_if(late).alias("corrected"), F.sort_array(F.collect_set(F.when(tells, F.col("pad_ms")))).alias("pads")
    )
    # the three series are one long table, so that the grid is walked once
    long = kept.select(*own, F.explode(F.create_map(*(x for k, v in SERIES.items() for x in (F.lit(k), F.col(v))))).alias("_series", "_value"))
    stats = exact_percentile(long, [*own, "_series"], "_value")
    fields = F.struct(*(c for c in stats.columns if c not in (*own, "_series")))
    out = out.join(stats.groupBy(*own).agg(*(F.first(F.when(F.col("_series") == k, fields), ignorenulls=True).alias(k) for k in SERIES)), own, "left")
    n, with_latency = F.coalesce("filtered", F.lit(0)), F.coalesce("corrected", F.lit(0))
    coverage = F.when(n > 0, with_latency / n).otherwise(0.0)
    enough = (n >= least) & (coverage >= 0.8)
    return out.select(
        *keys, "samples_total", n.alias("samples_filtered"), with_latency.alias("samples_with_output_latency"), F.round(coverage, 4).alias("output_latency_coverage"),
        F.coalesce("pads", F.array().cast("array<int>")).alias("pad_ms_values"), as_series("delta").alias("delta_ms"), as_series("latency").alias("output_latency_ms"),
        as_series("fixed").alias("corrected_delta_ms"), F.when(enough, F.round(as_series("fixed")["p50"]).cast("int")).alias("recommended_pad_adjust_ms"),
        F.when(enough, "p50(delta_ms + output_latency_ms)").otherwise("insufficient_data").alias("basis"),
    )
