"""Exact quantiles and related order statistics that scale with the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.operators.ordered import global_prefix


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                    num_partitions: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation between order statistics (R type 7,
    Spark ``percentile``, DuckDB ``quantile_cont``), per group.

    Equal values are counted first (summed up before the shuffle, so a value that
    most rows hold is one row), and no group's values are gathered in one buffer:
    the different values get range-sliced running counts (:func:`global_prefix`),
    and only those that hold a needed rank are kept and interpolated.  Output:
    group columns, ``prob``, ``q``.  NULL values are ignored.
    """
    group = list(group)
    v = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    values = v.groupBy(*group, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = global_prefix(values, ["__v"], sums=["__c"], group=group, num_partitions=num_partitions)
    # group sizes from the running counts (the largest), not a second pass over the input
    counts = ranked.groupBy(*group).agg(F.max("cum___c").alias("__cnt")).where(F.col("__cnt") > 0)
    spots = [(F.col("__cnt") - 1) * F.lit(float(p)) for p in probs]
    ranks = [(r(h) + 1).cast("long") for h in spots for r in (F.floor, F.ceil)]
    # one row per group: AQE broadcasts it when its runtime size is small; without groups it is one row
    want = counts.select(*group, F.array_distinct(F.array(*ranks)).alias("__ranks"))
    both = ranked.join(want, group) if group else ranked.join(F.broadcast(want))
    held = F.filter("__ranks", lambda r: (r <= F.col("cum___c")) & (r > F.col("cum___c") - F.col("__c")))
    hits = both.select(*group, "__v", F.explode(held).alias("__rank"))
    # a few rows per group and probability from here on
    at = hits.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    at = at.join(counts, group) if group else at.join(F.broadcast(counts))
    out = []
    for p, h in zip(probs, spots):
        lo, hi = (F.col("__at")[(r(h) + 1).cast("long")] for r in (F.floor, F.ceil))
        out.append(F.struct(F.lit(float(p)).alias("prob"), (lo + (h - F.floor(h)) * (hi - lo)).alias("q")))
    return at.select(*group, F.explode(F.array(*out)).alias("__o")).select(*group, "__o.prob", "__o.q")


def quantile_columns(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                     group: Sequence[str] = ()) -> DataFrame:
    """:func:`exact_quantiles` pivoted to one column per probability."""
    q = exact_quantiles(df, value, probs, group)
    aggs = [F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(n) for p, n in zip(probs, names)]
    if group:
        return q.groupBy(*group).agg(*aggs)
    return q.agg(*aggs)
