"""Flow-level operators: per-row gaps and running values, ids, totals, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtrace.functions.exprs import key_text, unset_to_zero
from flowtrace.operators.ordered import ordered_slices, slice_edges, slice_windows, with_edges
from flowtrace.schema import CONN_KEY

ORDER = ["ts", "uid"]
ROW_VALUES = ["orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration"]


def totals(flows: DataFrame) -> DataFrame:
    """Total bytes and packets per flow (unset counts as 0)."""
    return flows.select("uid",
                        (unset_to_zero("orig_bytes") + unset_to_zero("resp_bytes")).cast("bigint").alias("tot_bytes"),
                        (unset_to_zero("orig_pkts") + unset_to_zero("resp_pkts")).cast("bigint").alias("tot_pkts"))


def with_key_text(flows: DataFrame, key: Sequence[str] = CONN_KEY) -> DataFrame:
    return flows.select("uid", key_text(*key).alias("trace_key"))


def distinct_keys(flows: DataFrame, key: Sequence[str] = CONN_KEY) -> DataFrame:
    return flows.select(*key).dropDuplicates(list(key))


# ---------------------------------------------------------------------------
# ordered per-row scan (skew safe)
# ---------------------------------------------------------------------------

def ordered_rows(df: DataFrame, key: Sequence[str] = CONN_KEY, values: Sequence[str] = (),
                 num_partitions: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Per row, in (ts, uid) order within the key: position, gap to the previous
    and next row, running mean (frame: first row .. current) and distance to it.

    Equals ``lag``/``lead``/``avg() OVER (ROWS UNBOUNDED PRECEDING)`` by key,
    but a hot key is spread over many tasks (see :mod:`ordered`): the windows run
    inside a slice, and the edge table adds what lies before and after it.
    NULL key fields are equal to one another.  ``carry`` columns are passed
    through unchanged.
    """
    values = list(values)
    carry = [c for c in carry if c not in values]
    src = df.select(*key, *carry, "ts", "uid", *[F.col(v).cast("double").alias(v) for v in values])
    R = ordered_slices(src, key, ORDER, num_partitions)
    w, run = slice_windows(key, ORDER)
    inside = R.select("*", F.row_number().over(w).alias("__n"), F.lag("ts").over(w).alias("__prev"), F.lead("ts").over(w).alias("__next"),
                      *[F.sum(v).over(run).alias("__s_" + v) for v in values])
    rows = with_edges(inside, slice_edges(R, key, values), key)
    pos = F.col("__n") + F.coalesce("off_n", F.lit(0))
    mean = {v: (F.col("__s_" + v) + F.coalesce("off_" + v, F.lit(0.0))) / pos for v in values}
    return rows.select(
        *key, *carry, "ts", "uid", pos.cast("bigint").alias("pos"),
        (F.col("ts") - F.coalesce("__prev", "prev_last")).alias("gap_prev"),
        (F.coalesce("__next", "next_first") - F.col("ts")).alias("gap_next"),
        *[mean[v].alias("run_mean_" + v) for v in values], *[F.abs(F.col(v) - mean[v]).alias("dev_" + v) for v in values])


def reference_values(flows: DataFrame) -> DataFrame:
    """Flows with unset counts and durations as 0 (the reference view)."""
    return flows.withColumns({v: unset_to_zero(v) for v in ROW_VALUES})


def gaps(flows: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """uid, key, ts, gap_prev (NULL first), gap_next (NULL last), is_last."""
    r = ordered_rows(flows, CONN_KEY, (), num_partitions)
    return r.select("uid", *CONN_KEY, "ts", "gap_prev", "gap_next",
                    F.col("gap_next").isNull().cast("int").alias("is_last"))


def running_values(flows: DataFrame, num_partitions: int | None = None) -> DataFrame:
    r = ordered_rows(reference_values(flows), CONN_KEY, ROW_VALUES, num_partitions)
    return r.select("uid", *CONN_KEY, "ts", "pos", *["run_mean_" + v for v in ROW_VALUES],
                    *["dev_" + v for v in ROW_VALUES])


# ---------------------------------------------------------------------------
# trace ids
# ---------------------------------------------------------------------------

def trace_ids(flows: DataFrame, key: Sequence[str] = CONN_KEY, exact: bool = True,
              num_partitions: int | None = None) -> DataFrame:
    """Trace id per key.

    ``exact``: dense 0-based ids in order of first appearance (first ts, then
    key).  Keys are range-sorted in parallel; each row's id is the count of
    rows in earlier partitions (a broadcast table with one row per partition)
    plus its place in its partition.  Otherwise ``xxhash64`` of the key
    (no sort, not dense).
    """
    key = list(key)
    if not exact:
        return flows.select(*key).distinct().select(*key, F.xxhash64(*key).alias("trace_id"))
    firsts = flows.groupBy(*key).agg(F.min("ts").alias("first_ts"))
    order = ["first_ts"] + key
    from flowtrace.operators.ordered import require_checkpoint_dir, slice_count
    if num_partitions is None:
        num_partitions = slice_count(firsts)
    require_checkpoint_dir(flows)
    srt = (firsts.repartitionByRange(num_partitions, *order).sortWithinPartitions(*order)
           .withColumn("pid", F.spark_partition_id())
           .withColumn("mono", F.monotonically_increasing_id())).checkpoint(eager=True)
    sizes = srt.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a global window over it is tiny
    base = sizes.select("pid", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("base"))
    local = F.col("mono") - F.shiftleft(F.col("pid").cast("long"), 33)
    return (srt.join(F.broadcast(base), "pid")
            .select(*key, (F.col("base") + local).cast("bigint").alias("trace_id")))


def flows_with_ids(flows: DataFrame, ids: DataFrame, key: Sequence[str] = CONN_KEY) -> DataFrame:
    """Left join of flows to their trace ids (broadcast only below a checked size)."""
    return flows.join(ids, list(key), "left")


def mean_gap(flows: DataFrame, key: Sequence[str] = CONN_KEY) -> DataFrame:
    """Mean gap per trace = (last - first) / (n - 1); one-flow traces absent.

    Consecutive gaps telescope, so a plain aggregate (partial on the map
    side, no sort) gives the mean of the gaps.
    """
    return (flows.groupBy(*key)
            .agg(F.try_divide(F.max("ts") - F.min("ts"), F.count(F.lit(1)) - 1).alias("mean_gap"),
                 F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1).drop("n"))


def mean_duration(flows: DataFrame, key: Sequence[str] = CONN_KEY) -> DataFrame:
    return flows.groupBy(*key).agg(F.avg("duration").alias("mean_duration"))
