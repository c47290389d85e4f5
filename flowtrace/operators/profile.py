"""Profiles of trace tables: counts, missing values, quantiles, box numbers,
class means, contingency tables, top lists.  Wide statistics are computed in
one pass over a long (metric, value) form, never one job per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.operators.stats import exact_quantiles, quantile_columns


def long_form(df: DataFrame, metrics: Sequence[str], keep: Sequence[str] = (),
              name: str = "metric", value: str = "value") -> DataFrame:
    """Unpivot ``metrics`` to (metric, value) rows, all as double."""
    src = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    return src.unpivot(list(keep), list(metrics), name, value)


def value_counts(df: DataFrame, cols: Sequence[str], top: int | None = None) -> DataFrame:
    """Count of each value in each column (``field``, ``value``, ``n``).

    The columns are unpivoted once, so one aggregation (partial on the map
    side) serves all of them.  ``top``: only the ``top`` most frequent values
    of each column (ties by value), each a bounded take-ordered per task.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "field", "value")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return counts
    out = None
    for c in cols:
        part = counts.where(F.col("field") == c).orderBy(F.desc("n"), F.asc("value")).limit(top)
        out = part if out is None else out.unionByName(part)
    return out


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent values of one column (a top-k report)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(col)).limit(k)


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column: one aggregate, then unpivoted to (field, n_missing)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "field", "n_missing")


def five_numbers(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """min, quartiles, max of each metric (R ``quantile`` default rule)."""
    long = long_form(df, metrics).where(F.col("value").isNotNull())
    return quantile_columns(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], ["q0", "q25", "q50", "q75", "q100"],
                            group=["metric"])


def box_stats(df: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    """Box-plot numbers per (metric, class): quartiles, whiskers at 1.5 IQR
    (most extreme values inside the fences), count of values outside."""
    long = long_form(df, metrics, keep=[by]).where(F.col("value").isNotNull())
    q = quantile_columns(long, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], group=["metric", by])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    # q has one row per (metric, class); AQE broadcasts it from its runtime size
    j = long.join(q, ["metric", by])
    inside = (F.col("value") >= lo_f) & (F.col("value") <= hi_f)
    stats = j.groupBy("metric", by).agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return q.join(stats, ["metric", by])


def class_means(df: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.avg(m).alias("mean_" + m) for m in metrics])


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of every (a, b) pair, zeros kept; rows with a NULL in either column are not counted.

    A grouped pivot on ``b`` (its distinct values are few: a category)
    gives one row per ``a`` value with a column per ``b`` value, missing
    pairs as NULL -> 0; unpivoting returns the long table.
    """
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    levels = sorted(r[0] for r in df.select(b).distinct().collect())
    wide = df.groupBy(a).pivot(b, levels).agg(F.count(F.lit(1)))
    names = [str(v) for v in levels]
    wide = wide.select(a, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names])
    return wide.unpivot([a], names, b, "n")


def group_summary(df: DataFrame, by: str, metrics: Sequence[str], digits: int | None = None) -> DataFrame:
    """Median and sample sd of each metric per group (medians exact, distributed).

    ``digits``: round with half-to-even (``bround``), as R's ``round`` does."""
    long = long_form(df, metrics, keep=[by])
    med = exact_quantiles(long, "value", [0.5], group=[by, "metric"])
    sd = long.groupBy(by, "metric").agg(F.stddev_samp("value").alias("sd"))
    joined = med.join(sd, [by, "metric"])
    aggs = []
    for m in metrics:
        aggs += [F.max(F.when(F.col("metric") == m, F.col("q"))).alias("median_" + m),
                 F.max(F.when(F.col("metric") == m, F.col("sd"))).alias("sd_" + m)]
    out = joined.groupBy(by).agg(*aggs)
    if digits is not None:
        out = out.withColumns({c: F.bround(c, digits) for c in out.columns if c != by})
    return out


def below_quantile(df: DataFrame, metrics: Sequence[str], keep: Sequence[str], prob: float = 0.9) -> DataFrame:
    """Per metric, the rows whose value is below that metric's own quantile."""
    long = long_form(df, metrics, keep=keep)
    q = exact_quantiles(long, "value", [prob], group=["metric"])
    return long.join(q.select("metric", "q"), "metric").where(F.col("value") < F.col("q")).drop("q")
