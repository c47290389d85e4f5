"""Per-conversation trace tables (one row per key) from typed flows.

Two physical forms give the same connection-trace table:

* ``method="window"``: one window pass and one ``groupBy`` on the key (one
  hash exchange).  Every key is handled by one task, so a key holding a large
  share of all flows becomes one long task.
* ``method="segmented"`` (default): flows are cut into ordered slices by a
  range exchange on (key, ts, uid) (:mod:`flowtrace.operators.ordered`), so a
  hot key runs in many tasks.  Window functions inside a slice give one
  partial row per key and slice (count, sums, running deviation, gap
  count/mean/M2, flags).  The running mean of a key that began in an earlier
  slice starts from the count and sums before it, taken from a broadcast edge
  table of at most two rows per partition.  Partials are then merged per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtrace.functions.exprs import history_flags, unset_to_zero
from flowtrace.operators.ordered import ordered_slices, slice_edges, slice_windows, with_edges
from flowtrace.schema import FLAG_COLUMNS, TRACE_COLUMNS_A, TRACE_KEY, TRACE_VALUES

# flow column feeding each trace value (reference naming: src = originator)
VALUE_SOURCES = {"dest_bytes": "resp_bytes", "dest_pkts": "resp_pkts", "duration": "duration",
                 "src_bytes": "orig_bytes", "src_pkts": "orig_pkts"}
ORDER = ["ts", "uid"]


def trace_inputs(flows: DataFrame, exclude_protocols: Sequence[str] = ()) -> DataFrame:
    """Flows in the reference view: trace key names, unset values as 0, 20 flags."""
    if exclude_protocols:
        flows = flows.where(~F.col("proto").isin(list(exclude_protocols)))
    return flows.select(
        F.col("id_orig_h").alias("srcIP"), F.col("id_resp_h").alias("destIP"),
        F.col("id_resp_p").alias("destPt"), F.col("proto").alias("protocol"),
        "ts", "uid",
        *[unset_to_zero(src, "double").alias(v) for v, src in VALUE_SOURCES.items()],
        *history_flags("history"),
    )


def _finish(df: DataFrame, single_flow: str) -> DataFrame:
    if single_flow == "drop":
        df = df.where(F.col("flowct") > 1)
    elif single_flow == "null":
        nulls = {c: F.when(F.col("flowct") > 1, F.col(c)) for c in TRACE_COLUMNS_A
                 if c.startswith("stdev_") or c == "mean_intvl"}
        df = df.withColumns(nulls)
    return df.select(*TRACE_COLUMNS_A)


# ---------------------------------------------------------------------------
# window form
# ---------------------------------------------------------------------------

def conn_traces_window(flows: DataFrame, single_flow: str = "zero",
                       exclude_protocols: Sequence[str] = ()) -> DataFrame:
    """Connection traces with window functions (reference semantics).

    ``stdev_<v>`` is the mean absolute distance of each flow's value to the
    running mean up to and including it, in (ts, uid) order; ``intvl`` is the
    gap between consecutive flow start times (mean and population std).
    """
    v = trace_inputs(flows, exclude_protocols)
    w = Window.partitionBy(*TRACE_KEY).orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dev = [F.abs(F.col(x) - F.avg(x).over(run)).alias("dev_" + x) for x in TRACE_VALUES]
    gap = (F.col("ts") - F.lag("ts").over(w)).alias("gap")
    staged = v.select(*TRACE_KEY, "ts", *TRACE_VALUES, *FLAG_COLUMNS, *dev, gap)
    aggs = [F.min("ts").alias("startTime"), F.count(F.lit(1)).alias("flowct")]
    for x in TRACE_VALUES:
        aggs += [F.avg(x).alias("mean_" + x), F.avg("dev_" + x).alias("stdev_" + x)]
    aggs += [F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_intvl"),
             F.coalesce(F.stddev_pop("gap"), F.lit(0.0)).alias("stdev_intvl")]
    aggs += [F.sum(c).alias(c) for c in FLAG_COLUMNS]
    return _finish(staged.groupBy(*TRACE_KEY).agg(*aggs), single_flow)


# ---------------------------------------------------------------------------
# segmented form
# ---------------------------------------------------------------------------

def sorted_slices(flows: DataFrame, num_partitions: int | None = None,
                  exclude_protocols: Sequence[str] = ()) -> DataFrame:
    """Flows in the reference view, range-sliced on (key, ts, uid) and checkpointed."""
    v = trace_inputs(flows, exclude_protocols)
    fmask = sum((F.col(c).cast("long") * F.lit(1 << i)) for i, c in enumerate(FLAG_COLUMNS))
    v = v.select(*TRACE_KEY, "ts", "uid", *TRACE_VALUES, fmask.cast("long").alias("fmask"))
    return ordered_slices(v, TRACE_KEY, ORDER, num_partitions)


def conn_traces_segmented(flows: DataFrame, single_flow: str = "zero", num_partitions: int | None = None,
                          exclude_protocols: Sequence[str] = ()) -> DataFrame:
    """Connection traces, safe for hot keys (see module doc)."""
    R = sorted_slices(flows, num_partitions, exclude_protocols)
    w, run = slice_windows(TRACE_KEY, ORDER)
    inside = R.select("*", F.row_number().over(w).alias("pos"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"),
                      *[F.sum(x).over(run).alias("run_" + x) for x in TRACE_VALUES])
    rows = with_edges(inside, slice_edges(R, TRACE_KEY, TRACE_VALUES).drop("prev_last", "next_first"), TRACE_KEY)
    pos = F.col("pos") + F.coalesce("off_n", F.lit(0))
    mean = {x: (F.col("run_" + x) + F.coalesce("off_" + x, F.lit(0.0))) / pos for x in TRACE_VALUES}
    # one partial row per key and slice, with the exchange that the windows have made
    part = rows.groupBy("pid", *TRACE_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.sum(x).alias("s_" + x) for x in TRACE_VALUES], *[F.sum(F.abs(F.col(x) - mean[x])).alias("mad_" + x) for x in TRACE_VALUES],
        F.count("gap").alias("gn"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("gmean"),
        F.coalesce(F.var_pop("gap") * F.count("gap"), F.lit(0.0)).alias("gm2"),
        *[F.sum(F.shiftright("fmask", i).bitwiseAND(F.lit(1).cast("bigint"))).alias(c) for i, c in enumerate(FLAG_COLUMNS)])
    wk = Window.partitionBy(*TRACE_KEY)
    wo = wk.orderBy("pid")
    fixed = part.select("*", (F.col("first_ts") - F.lag("last_ts").over(wo)).alias("bgap"))
    # gaps of a key = gaps inside each slice + one gap per slice edge; merged as
    # (count, mean, M2) around the key's overall mean so the std stays stable
    has_b = F.col("bgap").isNotNull()
    seg_gn = F.col("gn") + has_b.cast("long")
    seg_gsum = F.col("gn") * F.col("gmean") + F.coalesce(F.col("bgap"), F.lit(0.0))
    mu = F.coalesce(F.try_divide(F.sum(seg_gsum).over(wk), F.sum(seg_gn).over(wk)), F.lit(0.0))
    staged = fixed.select("*", seg_gn.alias("seg_gn"), seg_gsum.alias("seg_gsum"), mu.alias("mu"))
    seg_m2 = (F.col("gm2") + F.col("gn") * (F.col("gmean") - F.col("mu")) ** 2
              + F.when(has_b, (F.col("bgap") - F.col("mu")) ** 2).otherwise(0.0))
    staged = staged.withColumn("seg_m2", seg_m2)
    n = F.sum("n")
    g = F.sum("seg_gn")
    aggs = [F.min("first_ts").alias("startTime"), n.alias("flowct")]
    for x in TRACE_VALUES:
        aggs += [(F.sum("s_" + x) / n).alias("mean_" + x), (F.sum("mad_" + x) / n).alias("stdev_" + x)]
    aggs += [F.coalesce(F.try_divide(F.sum("seg_gsum"), g), F.lit(0.0)).alias("mean_intvl"),
             F.coalesce(F.sqrt(F.greatest(F.try_divide(F.sum("seg_m2"), g), F.lit(0.0))),
                        F.lit(0.0)).alias("stdev_intvl")]
    aggs += [F.sum(c).alias(c) for c in FLAG_COLUMNS]
    return _finish(staged.groupBy(*TRACE_KEY).agg(*aggs), single_flow)


def conn_traces(flows: DataFrame, method: str = "segmented", single_flow: str = "zero",
                exclude_protocols: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Full connection-trace table, 38 columns (layout A).

    ``single_flow``: ``zero`` (deviation and gap columns 0 for one-flow
    traces), ``null`` or ``drop``.
    """
    if method == "window":
        return conn_traces_window(flows, single_flow, exclude_protocols)
    if method == "segmented":
        return conn_traces_segmented(flows, single_flow, num_partitions, exclude_protocols)
    raise ValueError(f"unknown method {method!r}")
