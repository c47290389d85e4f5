"""HTTP traces and the other trace layouts (B: sample std, C: medians), and
their union with the main layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.functions.exprs import history_flags, unset_to_zero
from flowtrace.operators.flows import ordered_rows
from flowtrace.schema import CONN_KEY, FLAG_COLUMNS, HTTP_KEY, TRACE_COLUMNS_A

B_VALUES = ["resp_bytes", "duration", "resp_pkts", "orig_pkts"]
LAYOUT_B = (["id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto", "ts", "flow_ct"]
            + [p + v for v in B_VALUES for p in ("mean_", "std_")] + ["mean_intvl", "std_intvl"] + FLAG_COLUMNS)
LAYOUT_C = (["id_orig_h", "id_resp_h", "id_orig_p", "id_resp_p", "proto"]
            + [p + v for v in B_VALUES for p in ("mean_", "med_", "std_")] + FLAG_COLUMNS)
# layout B/C column -> layout A column (same meaning or the nearest one)
TO_A = {"id_orig_h": "srcIP", "id_resp_h": "destIP", "id_resp_p": "destPt", "proto": "protocol",
        "ts": "startTime", "flow_ct": "flowct",
        "mean_resp_bytes": "mean_dest_bytes", "std_resp_bytes": "stdev_dest_bytes",
        "mean_duration": "mean_duration", "std_duration": "stdev_duration",
        "mean_resp_pkts": "mean_dest_pkts", "std_resp_pkts": "stdev_dest_pkts",
        "mean_orig_pkts": "mean_src_pkts", "std_orig_pkts": "stdev_src_pkts",
        "mean_intvl": "mean_intvl", "std_intvl": "stdev_intvl"}


def http_traces(http: DataFrame, key: Sequence[str] = HTTP_KEY) -> DataFrame:
    """Per (source, destination, port): flow count, mean request and response
    size (unset as 0) and mean gap between requests ((last-first)/(n-1), 0 for
    one request).  Pure aggregation: partial on the map side, no sort.
    """
    n = F.count(F.lit(1))
    return http.groupBy(*key).agg(
        F.coalesce(F.try_divide(F.max("ts") - F.min("ts"), n - 1), F.lit(0.0)).alias("avgFlowInterval"),
        n.alias("flowCount"),
        F.avg(unset_to_zero("request_body_len", "double")).alias("mean_request_size"),
        F.avg(unset_to_zero("response_body_len", "double")).alias("mean_response_size"),
    ).select(F.col(key[0]).alias("src_host"), F.col(key[1]).alias("dest_host"), F.col(key[2]).alias("dest_port"),
             "avgFlowInterval", "flowCount", "mean_request_size", "mean_response_size")


def _b_inputs(flows: DataFrame, exclude_protocols: Sequence[str]) -> DataFrame:
    if exclude_protocols:
        flows = flows.where(~F.col("proto").isin(list(exclude_protocols)))
    return flows.select(*CONN_KEY, "id_orig_p", "ts", "uid",
                        *[unset_to_zero(v, "double").alias(v) for v in B_VALUES], *history_flags("history"))


def _first_orig_port() -> F.Column:
    return F.min_by("id_orig_p", F.struct("ts", "uid")).alias("id_orig_p")


def traces_layout_b(flows: DataFrame, exclude_protocols: Sequence[str] = (),
                    num_partitions: int | None = None) -> DataFrame:
    """Layout B: first source port, start, count, mean and sample std of four
    values, mean and population std of gaps (NULL for one flow), flags."""
    v = _b_inputs(flows, exclude_protocols)
    fmask = sum((F.col(c).cast("long") * F.lit(1 << i)) for i, c in enumerate(FLAG_COLUMNS))
    v = v.select(*CONN_KEY, "id_orig_p", "ts", "uid", *B_VALUES, fmask.cast("long").alias("fmask"))
    rows = ordered_rows(v, CONN_KEY, (), num_partitions, carry=["id_orig_p", *B_VALUES, "fmask"])
    aggs = [_first_orig_port(), F.min("ts").alias("ts"), F.count(F.lit(1)).alias("flow_ct")]
    for x in B_VALUES:
        aggs += [F.avg(x).alias("mean_" + x), F.stddev_samp(x).alias("std_" + x)]
    aggs += [F.avg("gap_prev").alias("mean_intvl"), F.stddev_pop("gap_prev").alias("std_intvl")]
    aggs += [F.sum(F.shiftright("fmask", i).bitwiseAND(1)).alias(c) for i, c in enumerate(FLAG_COLUMNS)]
    return rows.groupBy(*CONN_KEY).agg(*aggs).select(*LAYOUT_B)


def traces_layout_c(flows: DataFrame, exclude_protocols: Sequence[str] = (), exact: bool = True,
                    accuracy: int = 10000, num_partitions: int | None = None) -> DataFrame:
    """Layout C: first source port, mean / median / sample std of four values, flags.

    ``exact`` medians are order statistics found by range-sliced ranks
    (:func:`flowtrace.operators.stats.exact_quantiles`, grouped by key and
    value): no key's values are buffered in one task, however hot the key.
    ``exact=False`` uses fixed-size ``percentile_approx`` sketches instead.
    """
    v = _b_inputs(flows, exclude_protocols)
    aggs = [_first_orig_port()]
    for x in B_VALUES:
        aggs += [F.avg(x).alias("mean_" + x), F.stddev_samp(x).alias("std_" + x)]
        if not exact:
            aggs.append(F.percentile_approx(x, 0.5, accuracy).cast("double").alias("med_" + x))
    aggs += [F.sum(c).alias(c) for c in FLAG_COLUMNS]
    base = v.groupBy(*CONN_KEY).agg(*aggs)
    if exact:
        from flowtrace.operators.stats import exact_quantiles
        long = v.select(*CONN_KEY, *B_VALUES).unpivot(list(CONN_KEY), B_VALUES, "metric", "value")
        med = exact_quantiles(long, "value", [0.5], list(CONN_KEY) + ["metric"], num_partitions)
        wide = med.groupBy(*CONN_KEY).agg(*[F.max(F.when(F.col("metric") == x, F.col("q"))).alias("med_" + x)
                                            for x in B_VALUES])
        base = base.join(wide, list(CONN_KEY))
    return base.select(*LAYOUT_C)


def to_layout(traces_a: DataFrame, layout: str) -> DataFrame:
    """Rename and cut a layout-A table to layout B or C column names."""
    back = {a: b for b, a in TO_A.items()}
    target = LAYOUT_B if layout == "B" else LAYOUT_C
    have = {back.get(c, c): c for c in traces_a.columns}
    return traces_a.select(*[F.col(have[c]).alias(c) for c in target if c in have])


def normalise_layout(df: DataFrame, layout: str) -> DataFrame:
    """Layout B or C table to layout-A names (columns A lacks are kept)."""
    out = df.select(*[F.col(c).alias(TO_A.get(c, c)) for c in df.columns])
    return out.withColumn("layout", F.lit(layout))


def union_layouts(frames: dict[str, DataFrame]) -> DataFrame:
    """One table from trace tables of layouts A, B, C (missing columns NULL)."""
    out = None
    for layout, df in frames.items():
        norm = df.withColumn("layout", F.lit("A")) if layout == "A" else normalise_layout(df, layout)
        out = norm if out is None else out.unionByName(norm, allowMissingColumns=True)
    cols = [c for c in TRACE_COLUMNS_A if c in out.columns] + [c for c in out.columns if c not in TRACE_COLUMNS_A]
    return out.select(*cols)
