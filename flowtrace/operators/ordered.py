"""Ordered per-key scans that stay parallel when one key is huge.

A window ``PARTITION BY key ORDER BY ts`` sends every row of a key to one
task.  Here rows are range-partitioned on (key, order...) instead: Spark
samples the data and cuts even a single hot key into contiguous slices, one
per partition.  Inside a slice plain window functions do the work; what a
slice needs from earlier or later slices of the same key (row count and sums
before it, last time before it, first time after it) comes from a small JVM
aggregate over the slices.  A key can only continue across a partition edge,
so that edge table has at most two rows per partition and is broadcast with
that bound.

The slices are checkpointed to the shared ``spark.checkpoint.dir``: every
consumer then sees the same slice ids, the range partitioning and order are
kept, and a lost executor does not force a new sampling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def require_checkpoint_dir(df: DataFrame) -> None:
    try:
        sc = df.sparkSession.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server checks its own folder)
        return
    if not sc.getCheckpointDir():
        raise RuntimeError("ordered scans need spark.checkpoint.dir (a shared folder); "
                           "see flowtrace.session.ensure_checkpoint_dir")


DEFAULT_SLICE_BYTES = 256 * 1024 * 1024


def _input_bytes(df: DataFrame, enough: int) -> int:
    """Bytes read by the plan: the sum of its leaf relations' size estimates
    (file sizes for scans).  Estimates of derived nodes (joins, explode) are
    products and can be far off, so only leaves are used.  A checkpoint is a leaf
    that keeps the estimate of its plan; where that gives more than ``enough``,
    the rows are counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    unknown = int(df.sparkSession.conf.get("spark.sql.defaultSizeInBytes", str(2 ** 63 - 1)))
    total, guessed = 0, False
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = leaf.stats().sizeInBytes()
        size = int(size if isinstance(size, int) else size.toString())
        guessed = guessed or size >= unknown or leaf.nodeName() == "LogicalRDD"
        total += size
    return df.count() * (16 * len(df.columns) + 8) if guessed and total > enough else total


def slice_count(df: DataFrame) -> int:
    """Number of slices: enough that each holds about ``flowtrace.slice.bytes``
    (default 256 MiB) of the data read (its rows are counted where a plan has no
    usable estimate or reads a checkpoint with a large one), and
    at least min(``spark.sql.shuffle.partitions``, default parallelism) so all
    cores work.  (AQE does not coalesce an explicit range repartition, so the
    floor is not the shuffle-partition count alone.)"""
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        base = min(base, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001  (Spark Connect)
        pass
    target = int(spark.conf.get("flowtrace.slice.bytes", None) or DEFAULT_SLICE_BYTES)
    try:
        est = _input_bytes(df, base * target)
    except Exception:  # noqa: BLE001  (estimates are optional)
        est = 0
    return max(base, -(-est // target))


def ordered_slices(df: DataFrame, key: Sequence[str], order: Sequence[str],
                   num_partitions: int | None = None) -> DataFrame:
    """Range-partition on key + order, sort inside partitions, tag ``pid``; checkpoint."""
    require_checkpoint_dir(df)
    if num_partitions is None:
        num_partitions = slice_count(df)
    cols = list(key) + list(order)
    sliced = (df.repartitionByRange(num_partitions, *cols)
              .sortWithinPartitions(*cols)
              .withColumn("pid", F.spark_partition_id()))
    return sliced.checkpoint(eager=True)


def slice_edges(R: DataFrame, key: Sequence[str], sums: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Per (key, pid) where the key also lies in another slice: what the windows need.

    Columns: ``off_n`` and ``off_<c>`` (count and sums of the key in earlier
    slices), ``prev_last`` (last ``ts`` of the key before this slice) and
    ``next_first`` (first ``ts`` after it).  A key can go on in another slice only
    if it is the first or the last of its own, so only the rows of these keys are
    summed up: at most two rows per partition.
    """
    one = F.struct(*key)
    ends = R.groupBy("pid").agg(F.min(one).alias("__lo"), F.max(one).alias("__hi"))  # one row a slice: broadcast
    at_end = R.join(F.broadcast(ends), "pid").where(one.eqNullSafe(F.col("__lo")) | one.eqNullSafe(F.col("__hi")))
    wk = Window.partitionBy(*key).orderBy("pid")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    per_slice = at_end.groupBy(*key, "pid").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"),
                                                F.max(ts).alias("hi"), *[F.sum(c).alias("s_" + c) for c in sums])
    edges = per_slice.select(
        *key, "pid",
        F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("off_n"),
        *[F.coalesce(F.sum("s_" + c).over(before), F.lit(0.0)).cast("double").alias("off_" + c) for c in sums],
        F.lag("hi").over(wk).cast("double").alias("prev_last"),
        F.lead("lo").over(wk).cast("double").alias("next_first"),
    )
    return edges.where(F.col("prev_last").isNotNull() | F.col("next_first").isNotNull())


def with_edges(R: DataFrame, edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attach edge values to each row (broadcast); rows of keys within one slice get NULLs.

    Keys are compared null-safely: a key with an unset field is a key like any other.
    """
    names = [*key, "pid"]
    its = edges.withColumnsRenamed({c: "__e_" + c for c in names})
    same = F.lit(True)
    for c in names:
        same = same & R[c].eqNullSafe(its["__e_" + c])
    return R.join(F.broadcast(its), same, "left").drop(*["__e_" + c for c in names])


def slice_windows(key: Sequence[str], order: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """The window of a key's rows in one slice, and its running frame."""
    w = Window.partitionBy("pid", *key).orderBy(*order)
    return w, w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def global_prefix(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), group: Sequence[str] = (),
                  num_partitions: int | None = None, descending: bool = False) -> DataFrame:
    """Running count (``rank``, 1-based) and running sums (``cum_<c>``, inclusive)
    in ``order`` within each ``group``, over the whole table.

    A plain ``Window.orderBy`` would move every row to one task.  Here the rows
    are range-sliced; each slice's totals per group (at most groups x
    partitions rows, broadcast) give the offset that the slice's own running
    sums start from.
    """
    group, order, sums = list(group), list(order), list(sums)
    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    if descending:
        df = df.select("*", *[(-F.col(c)).alias("__neg_" + c) for c in order])
        sort_cols = ["__neg_" + c for c in order]
    else:
        sort_cols = order
    R = ordered_slices(df, group, sort_cols, num_partitions)
    totals = R.groupBy(*group, "pid").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias("__s_" + c) for c in sums])
    wp = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1) if group else \
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*group, "pid", F.coalesce(F.sum("__n").over(wp), F.lit(0)).alias("__off_n"),
                         *[F.coalesce(F.sum("__s_" + c).over(wp), F.lit(0)).alias("__off_" + c) for c in sums])
    run = Window.partitionBy("pid", *group).orderBy(*ocols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # offs: one row per (group, partition); without groups that is the partition
    # count (broadcast); with groups AQE decides from its runtime size
    offs = F.broadcast(offs) if not group else offs
    out = R.join(offs, group + ["pid"], "left").select(
        *[c for c in R.columns if c != "pid" and not c.startswith("__neg_")],
        (F.col("__off_n") + F.count(F.lit(1)).over(run)).alias("rank"),
        *[(F.col("__off_" + c) + F.sum(c).over(run)).alias("cum_" + c) for c in sums])
    return out
