"""Repeatable samples and splits.

Every random choice is a hash: ``md5('<seed>|<id>')`` as hex text (the same
in Spark and DuckDB).  Fractions cut on the first 8 hex digits, so no sort is
needed; fixed-size samples rank by the hash with the range-sliced running
count of :func:`flowtrace.operators.ordered.global_prefix` (no single-task
window, no ``limit`` over a global sort).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.functions.exprs import hash_order
from flowtrace.operators.ordered import global_prefix


def hash_prefix(seed, id_col) -> F.Column:
    return F.substring(hash_order(seed, id_col), 1, 8)


def hash_cut(seed, id_col, fraction: float) -> F.Column:
    """True for about ``fraction`` of ids: first 8 hex digits below the cut.

    Fixed-width lower-case hex compares like the number it spells, so the
    cut is a string comparison (exact, engine independent).
    """
    threshold = min(math.ceil(fraction * 2 ** 32), 2 ** 32)
    if threshold >= 2 ** 32:
        return F.lit(True)
    return hash_prefix(seed, id_col) < F.lit(f"{threshold:08x}")


def hash_bucket(seed, id_col, k: int) -> F.Column:
    """Bucket 0..k-1 from the first 8 hex digits (for folds)."""
    return (F.conv(hash_prefix(seed, id_col), 16, 10).cast("bigint") % k).cast("int")


def with_id(df: DataFrame, id_cols: Sequence[str], name: str = "row_id") -> DataFrame:
    """Stable row id from the data (key columns joined by '|'), not from position."""
    if len(id_cols) == 1:
        return df.withColumn(name, F.col(id_cols[0]).cast("string"))
    return df.withColumn(name, F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols]))


def split_fraction(df: DataFrame, id_col: str, fraction: float = 0.7, seed=11) -> DataFrame:
    """``part`` = train for about ``fraction`` of rows, else test."""
    return df.withColumn("part", F.when(hash_cut(seed, id_col, fraction), "train").otherwise("test"))


def split_fixed(df: DataFrame, id_col: str, k: int, seed=11, num_partitions: int | None = None) -> DataFrame:
    """Exactly ``k`` rows (lowest hashes) are train, the rest test."""
    h = df.withColumn("__h", hash_order(seed, id_col))
    ranked = global_prefix(h, ["__h"], num_partitions=num_partitions)
    return ranked.withColumn("part", F.when(F.col("rank") <= k, "train").otherwise("test")).drop("__h", "rank")


def sample_rows(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Rows in the sample (semi join on the id)."""
    return df.join(sample.select(id_col), id_col, "left_semi")


def rest_rows(df: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Rows not in the sample (anti join on the id)."""
    return df.join(sample.select(id_col), id_col, "left_anti")


def leave_family_out(df: DataFrame, id_col: str, families: Sequence[str], family_col: str = "Family",
                     normal: str = "Normal", seed=11, num_partitions: int | None = None) -> DataFrame:
    """All folds in one table: ``fold_family`` and ``part`` per row.

    Fold f: test = rows of family f plus as many normal rows (the lowest
    hashes); train = rows of the other families plus the other normal rows.
    Normal rows are ranked once for all folds.
    """
    counts = (df.where(F.col(family_col).isin(list(families)))
              .groupBy(family_col).agg(F.count(F.lit(1)).alias("__nf")))
    normals = global_prefix(df.where(F.col(family_col) == normal).withColumn("__h", hash_order(seed, id_col)),
                            ["__h"], num_partitions=num_partitions).select(id_col, F.col("rank").alias("__nrank"))
    folds = F.explode(F.array(*[F.lit(f) for f in families])).alias("fold_family")
    # one row per family: broadcast
    fam_n = counts.select(F.col(family_col).alias("fold_family"), "__nf")
    base = df.join(normals, id_col, "left").select("*", folds)
    base = base.join(F.broadcast(fam_n), "fold_family", "left")
    is_test = ((F.col(family_col) == F.col("fold_family"))
               | ((F.col(family_col) == normal) & (F.col("__nrank") <= F.coalesce(F.col("__nf"), F.lit(0)))))
    return (base.where(F.col(family_col).isNotNull())
            .withColumn("part", F.when(is_test, "test").otherwise("train"))
            .drop("__nrank", "__nf"))


def class_counts(df: DataFrame, label: str) -> list[tuple]:
    """(label, count) per class, smallest first; one row per class reaches the driver."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r[label], r["n"]) for r in rows), key=lambda t: (t[1], t[0]))


def oversample(df: DataFrame, label: str, rate: int, minority=None) -> DataFrame:
    """Minority class rows repeated ``rate`` times (``copy`` = 1..rate); exact copies."""
    if minority is None:
        minority = class_counts(df, label)[0][0]
    copies = F.when(F.col(label) == F.lit(minority), F.lit(rate)).otherwise(F.lit(1))
    return df.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy"))


def undersample(df: DataFrame, label: str, id_col: str, rate: float, seed=11, majority=None) -> DataFrame:
    """Majority class rows kept with hash fraction ``rate``; minority kept whole."""
    if majority is None:
        majority = class_counts(df, label)[-1][0]
    return df.where((F.col(label) != F.lit(majority)) | hash_cut(seed, id_col, rate))


def cv_folds(df: DataFrame, id_col: str, k: int = 10, seed=11) -> DataFrame:
    return df.withColumn("fold", hash_bucket(seed, id_col, k))
