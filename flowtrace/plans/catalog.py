"""The registered queries (one per operator that can stand alone).

Each builder takes (spark, sf_dir) and reads the driver tables; the SQL twin
runs in DuckDB on the same tables.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowtrace.operators import traces as tr
from flowtrace.plans import sqlviews as V
from flowtrace.plans.registry import query, with_ctes
from flowtrace.sources import fixture as fx


@query("conn_traces", "A7 (A1-A6, P2, P5, W3, W4)",
       with_ctes(V.TRACES, "SELECT * FROM traces"))
def conn_traces(spark, sf_dir):
    return tr.conn_traces(fx.flows(spark, sf_dir))


# --- flows: expressions, per-row windows, ids -------------------------------

from flowtrace.functions.exprs import history_flags  # noqa: E402
from flowtrace.operators import flows as fl  # noqa: E402
from flowtrace.schema import FLAG_COLUMNS  # noqa: E402

_K = "id_orig_h, id_resp_h, id_resp_p, proto"
_WK = f"PARTITION BY {_K} ORDER BY ts, uid"
_FLAGS_SQL = ", ".join(FLAG_COLUMNS)


@query("flow_flags", "P5", with_ctes(V.FLOWS, "SELECT uid, " + ", ".join(
    f"coalesce(CAST(instr(history, '{c[-1]}') > 0 AS INTEGER), 0) AS {c}" for c in FLAG_COLUMNS) + " FROM flows"))
def flow_flags(spark, sf_dir):
    return fx.flows(spark, sf_dir).select("uid", *history_flags("history"))


@query("flow_totals", "P4", with_ctes(V.FLOWS, """
SELECT uid, CAST(coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) AS BIGINT) AS tot_bytes,
       CAST(coalesce(orig_pkts, 0) + coalesce(resp_pkts, 0) AS BIGINT) AS tot_pkts FROM flows"""))
def flow_totals(spark, sf_dir):
    return fl.totals(fx.flows(spark, sf_dir))


@query("flow_keys", "P6", with_ctes(V.FLOWS, f"""
SELECT uid, concat_ws('|', id_orig_h, CAST(id_resp_h AS VARCHAR), CAST(id_resp_p AS VARCHAR), proto) AS trace_key
FROM flows"""))
def flow_keys(spark, sf_dir):
    return fl.with_key_text(fx.flows(spark, sf_dir))


@query("flow_gaps_lead", "W1", with_ctes(V.FLOWS, f"SELECT uid, lead(ts) OVER ({_WK}) - ts AS gap_next FROM flows"))
def flow_gaps_lead(spark, sf_dir):
    return fl.gaps(fx.flows(spark, sf_dir)).select("uid", "gap_next")


@query("flow_gaps_lag", "W3", with_ctes(V.FLOWS, f"SELECT uid, ts - lag(ts) OVER ({_WK}) AS gap_prev FROM flows"))
def flow_gaps_lag(spark, sf_dir):
    return fl.gaps(fx.flows(spark, sf_dir)).select("uid", "gap_prev")


@query("last_flow", "W2", with_ctes(V.FLOWS, f"""
SELECT uid, CASE WHEN g IS NULL THEN 1 ELSE 0 END AS is_last, coalesce(g, -1.0) AS time_interval
FROM (SELECT uid, lead(ts) OVER ({_WK}) - ts AS g FROM flows)"""))
def last_flow(spark, sf_dir):
    g = fl.gaps(fx.flows(spark, sf_dir))
    return g.select("uid", "is_last", F.coalesce("gap_next", F.lit(-1.0)).alias("time_interval"))


_RV = ["orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration"]


@query("running_mean", "W4", with_ctes(V.FLOWS, "SELECT uid, " + f"CAST(row_number() OVER ({_WK}) AS BIGINT) AS pos, " + ", ".join(
    f"avg(CAST(coalesce({v}, 0) AS DOUBLE)) OVER ({_WK} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_mean_{v}"
    for v in _RV) + " FROM flows"))
def running_mean(spark, sf_dir):
    r = fl.running_values(fx.flows(spark, sf_dir))
    return r.select("uid", "pos", *["run_mean_" + v for v in _RV])


@query("running_mad", "A3", with_ctes(V.TRACES, "SELECT srcIP, destIP, destPt, protocol, flowct, " + ", ".join(
    f"stdev_{v}" for v in tr.TRACE_VALUES) + " FROM traces"))
def running_mad(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir))
    return t.select(*tr.TRACE_KEY, "flowct", *["stdev_" + v for v in tr.TRACE_VALUES])


_IDS_SQL = f"""
ids AS (SELECT {_K}, CAST(row_number() OVER (ORDER BY first_ts, {_K}) - 1 AS BIGINT) AS trace_id
        FROM (SELECT {_K}, min(ts) AS first_ts FROM flows GROUP BY {_K}))"""


@query("trace_ids", "W5", with_ctes(V.FLOWS + "," + _IDS_SQL, "SELECT * FROM ids"))
def trace_ids(spark, sf_dir):
    return fl.trace_ids(fx.flows(spark, sf_dir))


@query("flows_with_ids", "J1", with_ctes(V.FLOWS + "," + _IDS_SQL,
                                         f"SELECT f.uid, i.trace_id FROM flows f LEFT JOIN ids i USING ({_K})"))
def flows_with_ids(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return fl.flows_with_ids(f, fl.trace_ids(f)).select("uid", "trace_id")


@query("mean_gap", "A9", with_ctes(V.FLOWS + "," + _IDS_SQL, f"""
SELECT i.trace_id, g.mean_gap FROM
  (SELECT {_K}, avg(gap) AS mean_gap FROM
     (SELECT {_K}, lead(ts) OVER ({_WK}) - ts AS gap FROM flows) WHERE gap >= 0 GROUP BY {_K}) g
  JOIN ids i USING ({_K})"""))
def mean_gap(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return fl.mean_gap(f).join(fl.trace_ids(f), fl.CONN_KEY).select("trace_id", "mean_gap")


@query("mean_duration", "A10", with_ctes(V.FLOWS + "," + _IDS_SQL, f"""
SELECT i.trace_id, d.mean_duration FROM
  (SELECT {_K}, avg(duration) AS mean_duration FROM flows GROUP BY {_K}) d JOIN ids i USING ({_K})"""))
def mean_duration(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return fl.mean_duration(f).join(fl.trace_ids(f), fl.CONN_KEY).select("trace_id", "mean_duration")


@query("distinct_keys", "A20", with_ctes(V.FLOWS, f"SELECT DISTINCT {_K} FROM flows"))
def distinct_keys(spark, sf_dir):
    return fl.distinct_keys(fx.flows(spark, sf_dir))


@query("exclude_protocols", "F9", with_ctes(V.TRACES, "SELECT * FROM traces WHERE protocol NOT IN ('icmp')"))
def exclude_protocols(spark, sf_dir):
    return tr.conn_traces(fx.flows(spark, sf_dir), exclude_protocols=["icmp"])


# --- other trace tables ---------------------------------------------------

from flowtrace.operators import layouts as ly  # noqa: E402

_FLAGS_SUM = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in FLAG_COLUMNS)
_BIN = V.FLOWS + """,
bin AS (SELECT id_orig_h, id_resp_h, id_resp_p, proto, id_orig_p, ts, uid,
          CAST(coalesce(resp_bytes, 0) AS DOUBLE) AS resp_bytes, CAST(coalesce(duration, 0) AS DOUBLE) AS duration,
          CAST(coalesce(resp_pkts, 0) AS DOUBLE) AS resp_pkts, CAST(coalesce(orig_pkts, 0) AS DOUBLE) AS orig_pkts,
          """ + ", ".join(f"coalesce(CAST(instr(history, '{c[-1]}') > 0 AS INTEGER), 0) AS {c}" for c in FLAG_COLUMNS) + f"""
        FROM flows WHERE proto NOT IN ('icmp')),
bw AS (SELECT *, ts - lag(ts) OVER ({_WK}) AS gap, first_value(id_orig_p) OVER ({_WK}) AS first_p FROM bin)"""
_BV = ["resp_bytes", "duration", "resp_pkts", "orig_pkts"]


@query("http_traces", "A8", with_ctes(V.FLOWS, """
SELECT id_orig_h AS src_host, id_resp_h AS dest_host, id_resp_p AS dest_port,
       CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) / (count(*) - 1) ELSE 0.0 END AS avgFlowInterval,
       count(*) AS flowCount, avg(CAST(coalesce(orig_bytes, 0) AS DOUBLE)) AS mean_request_size,
       avg(CAST(coalesce(resp_bytes, 0) AS DOUBLE)) AS mean_response_size
FROM flows WHERE proto = 'tcp' GROUP BY id_orig_h, id_resp_h, id_resp_p"""))
def http_traces(spark, sf_dir):
    return ly.http_traces(fx.http_records(fx.flows(spark, sf_dir)))


@query("traces_layout_b", "A11", with_ctes(_BIN, f"""
SELECT {_K}, any_value(first_p) AS id_orig_p, min(ts) AS ts, count(*) AS flow_ct,
       {", ".join(f"avg({v}) AS mean_{v}, stddev_samp({v}) AS std_{v}" for v in _BV)},
       avg(gap) AS mean_intvl, stddev_pop(gap) AS std_intvl, {_FLAGS_SUM}
FROM bw GROUP BY {_K}"""))
def traces_layout_b(spark, sf_dir):
    return ly.traces_layout_b(fx.flows(spark, sf_dir), exclude_protocols=["icmp"])


@query("traces_layout_c", "A12", with_ctes(_BIN, f"""
SELECT {_K}, any_value(first_p) AS id_orig_p,
       {", ".join(f"avg({v}) AS mean_{v}, quantile_cont({v}, 0.5) AS med_{v}, stddev_samp({v}) AS std_{v}" for v in _BV)},
       {_FLAGS_SUM}
FROM bw GROUP BY {_K}"""))
def traces_layout_c(spark, sf_dir):
    return ly.traces_layout_c(fx.flows(spark, sf_dir), exclude_protocols=["icmp"])


_B_AS_A = ("srcIP, destIP, destPt, protocol, startTime, flowct, mean_dest_bytes, stdev_dest_bytes, mean_duration, "
           "stdev_duration, mean_dest_pkts, stdev_dest_pkts, mean_src_pkts, stdev_src_pkts, mean_intvl, stdev_intvl, ")
_C_AS_A = ("srcIP, destIP, destPt, protocol, mean_dest_bytes, stdev_dest_bytes, mean_duration, stdev_duration, "
           "mean_dest_pkts, stdev_dest_pkts, mean_src_pkts, stdev_src_pkts, ")


@query("union_layouts", "U3", with_ctes(V.TRACES, f"""
SELECT *, 'A' AS layout FROM traces
UNION ALL BY NAME SELECT {_B_AS_A}{_FLAGS_SQL}, 'B' AS layout FROM traces
UNION ALL BY NAME SELECT {_C_AS_A}{_FLAGS_SQL}, 'C' AS layout FROM traces"""))
def union_layouts(spark, sf_dir):
    a = _traces(spark, sf_dir)
    return ly.union_layouts({"A": a, "B": ly.to_layout(a, "B"), "C": ly.to_layout(a, "C")})


# --- sources and sinks ----------------------------------------------------

from flowtrace.operators import dataset as ds  # noqa: E402
from flowtrace.schema import CONN_KEPT, HTTP_FIELDS, TRACE_COLUMNS_A, column_name  # noqa: E402
from flowtrace.sources import csvio  # noqa: E402
from flowtrace.sources import zeek  # noqa: E402

_KEPT_COLS = ", ".join(column_name(f) for f in CONN_KEPT)


@query("log_roundtrip", "S1 S3 S8 P1 P3 + log writer", with_ctes(V.FLOWS, f"SELECT {_KEPT_COLS} FROM flows"))
def log_roundtrip(spark, sf_dir):
    path = csvio.scratch_path(spark, "conn_log")
    zeek.write_log(fx.flows(spark, sf_dir), path)
    return zeek.read_conn_log(spark, path)


# of every 53 flows four are written a second time as bad lines: cut short, a bad port, a bad time, a field too many
@query("log_rejects", "P3 S3 (typed rows and rejects of one parse)", with_ctes(V.FLOWS + """,
n AS (SELECT uid, CAST(substr(uid, 2) AS BIGINT) % 53 AS kind FROM flows)""", """
SELECT 'typed' AS part, uid, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS reason FROM n
UNION ALL SELECT 'reject', uid, CASE kind WHEN 1 THEN 'id.resp_p' WHEN 2 THEN 'ts' END,
  CASE kind WHEN 0 THEN '5 of 21 fields' WHEN 1 THEN 'not a port' WHEN 2 THEN 'not a time' ELSE '22 of 21 fields' END FROM n WHERE kind < 4"""))
def log_rejects(spark, sf_dir):
    good, bad, out = csvio.scratch_path(spark, "log_good"), csvio.scratch_path(spark, "log_bad"), csvio.scratch_path(spark, "log_parsed")
    flows = fx.flows(spark, sf_dir)
    zeek.write_log(flows, good)
    parts, kind = F.split("value", "\t"), F.substring(F.split_part("value", F.lit("\t"), F.lit(2)), 2, 20).cast("bigint") % 53
    at = lambda place, text: F.transform(parts, lambda x, i: F.when(i == place, text).otherwise(x))
    spoilt = (F.when(kind == 0, F.slice(parts, 1, 5)).when(kind == 1, at(5, F.concat(F.lit("x"), parts[5])))
              .when(kind == 2, at(0, F.lit("abc"))).when(kind == 3, F.array_append(parts, F.lit("more"))))
    lines = zeek.to_log_lines(flows).select(F.array_join(spoilt, "\t").alias("value")).where("value IS NOT NULL")
    zeek.write_lines(lines, bad, zeek.CONN_FIELDS)
    typed, rejects, _ = zeek.read_log_checked(spark, [good, bad], out, CONN_KEPT)
    none = F.lit(None).cast("string")
    return typed.select(F.lit("typed").alias("part"), "uid", none.alias("field"), none.alias("reason")).unionByName(
        rejects.select(F.lit("reject").alias("part"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("uid"), "field", "reason"))


@query("log_all_fields", "S2 P16", with_ctes(V.FLOWS, """
SELECT printf('%.6f', ts) AS ts, uid, id_orig_h, CAST(id_orig_p AS VARCHAR) AS id_orig_p, id_resp_h,
       CAST(id_resp_p AS VARCHAR) AS id_resp_p, proto, coalesce(service, '-') AS service,
       coalesce(printf('%.6f', duration), '-') AS duration, coalesce(CAST(orig_bytes AS VARCHAR), '-') AS orig_bytes,
       CAST(resp_bytes AS VARCHAR) AS resp_bytes, conn_state, 'T' AS local_orig, 'F' AS local_resp,
       CAST(missed_bytes AS VARCHAR) AS missed_bytes, coalesce(history, '-') AS history,
       CAST(orig_pkts AS VARCHAR) AS orig_pkts, CAST(orig_ip_bytes AS VARCHAR) AS orig_ip_bytes,
       CAST(resp_pkts AS VARCHAR) AS resp_pkts, CAST(resp_ip_bytes AS VARCHAR) AS resp_ip_bytes,
       '(empty)' AS tunnel_parents
FROM flows"""))
def log_all_fields(spark, sf_dir):
    path = csvio.scratch_path(spark, "conn_log_all")
    zeek.write_log(fx.flows(spark, sf_dir), path)
    return zeek.read_conn_log(spark, path, fields="*", as_text=True)


_HTTP_SQL = """
SELECT ts, id_orig_h, id_orig_p, id_resp_h, id_resp_p, id_resp_h AS host, orig_bytes AS request_body_len,
       CAST(NULL AS VARCHAR) AS proxied, CASE WHEN CAST(resp_bytes / 37 AS INTEGER) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,
       CAST(NULL AS VARCHAR) AS orig_filenames, CAST(NULL AS VARCHAR) AS resp_filenames, resp_bytes AS response_body_len,
       CAST(NULL AS BIGINT) AS status_code, CAST(NULL AS VARCHAR) AS status_msg, CAST(NULL AS VARCHAR) AS tags,
       CAST(NULL AS VARCHAR) AS user_agent, '/a,b?k=' || CAST(CAST(resp_bytes / 37 AS INTEGER) AS VARCHAR) AS uri,
       CAST(NULL AS VARCHAR) AS version
FROM flows WHERE proto = 'tcp'"""


@query("http_log_roundtrip", "S4 + log writer", with_ctes(V.FLOWS, _HTTP_SQL))
def http_log_roundtrip(spark, sf_dir):
    path = csvio.scratch_path(spark, "http_log")
    zeek.write_log(fx.http_records(fx.flows(spark, sf_dir)), path, HTTP_FIELDS, path_name="http")
    return zeek.read_http_log(spark, path)


_HTTP_TRACES_SQL = """
SELECT id_orig_h AS src_host, id_resp_h AS dest_host, id_resp_p AS dest_port,
       CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) / (count(*) - 1) ELSE 0.0 END AS avgFlowInterval,
       count(*) AS flowCount, avg(CAST(coalesce(orig_bytes, 0) AS DOUBLE)) AS mean_request_size,
       avg(CAST(coalesce(resp_bytes, 0) AS DOUBLE)) AS mean_response_size
FROM flows WHERE proto = 'tcp' GROUP BY id_orig_h, id_resp_h, id_resp_p"""


@query("http_log_to_traces", "S4 S10 S5 A8 S13 (capture to HTTP traces)", with_ctes(V.FLOWS, _HTTP_TRACES_SQL))
def http_log_to_traces(spark, sf_dir):
    log_dir, csv_dir, out_dir = (csvio.scratch_path(spark, n) for n in ("http_log", "http_csv", "http_traces"))
    zeek.write_log(fx.http_records(fx.flows(spark, sf_dir)), log_dir, HTTP_FIELDS, path_name="http")
    csvio.write_csv(zeek.read_http_log(spark, log_dir), csv_dir)
    http_schema = zeek.read_http_log(spark, log_dir).schema
    traces = ly.http_traces(csvio.read_csv(spark, csv_dir, http_schema))
    csvio.write_csv(traces, out_dir)
    return csvio.read_csv(spark, out_dir, traces.schema)


@query("csv_flows", "S6 S11", with_ctes(V.FLOWS, f"SELECT {_KEPT_COLS} FROM flows"))
def csv_flows(spark, sf_dir):
    path = csvio.scratch_path(spark, "flows_csv")
    kept = fx.flows(spark, sf_dir).select(*[column_name(f) for f in CONN_KEPT])
    csvio.write_csv(kept, path)
    return csvio.read_csv(spark, path, kept.schema)


def _labelled(spark, sf_dir):
    """Trace table with capture labels, written once (reliable checkpoint):
    most of its consumers read it more than once (profiles, splits, models),
    and it has one row per conversation, far fewer than flows."""
    lab = ds.label_traces(tr.conn_traces(fx.flows(spark, sf_dir)), fx.capture_labels(spark))
    return lab.checkpoint(eager=True)


def _traces(spark, sf_dir):
    """The trace table, written once, for queries that read it more than once."""
    return tr.conn_traces(fx.flows(spark, sf_dir)).checkpoint(eager=True)


_TCOLS = ", ".join(TRACE_COLUMNS_A)


@query("trace_csv", "S7 S12", with_ctes(V.LABELLED, f"SELECT {_TCOLS}, File FROM labelled"))
def trace_csv(spark, sf_dir):
    path = csvio.scratch_path(spark, "traces")
    lab = _labelled(spark, sf_dir)
    csvio.write_csv(lab.select(*TRACE_COLUMNS_A, "File"), path, partition_by=["File"])
    schema = lab.select(*TRACE_COLUMNS_A).schema
    return csvio.read_trace_tables(spark, path, schema)


@query("source_file", "S9", with_ctes(V.LABELLED, "SELECT File, count(*) AS n_traces FROM labelled GROUP BY File"))
def source_file(spark, sf_dir):
    path = csvio.scratch_path(spark, "traces_by_file")
    lab = _labelled(spark, sf_dir)
    csvio.write_parquet(lab.select(*TRACE_COLUMNS_A, "File"), path, partition_by=["File"])
    return spark.read.parquet(path).groupBy("File").agg(F.count(F.lit(1)).alias("n_traces"))


# --- labelled dataset -----------------------------------------------------

from flowtrace.schema import SKEWED_FEATURES, feature_name  # noqa: E402

_TK = "srcIP, destIP, destPt, protocol"


@query("label_join", "J3 P11", with_ctes(V.LABELLED, f"""
SELECT {_TK}, flowct, File, Family, Type, Malicious,
       CAST(CASE Family WHEN 'Bunitu' THEN 1 WHEN 'Conficker' THEN 2 WHEN 'Dridex' THEN 3 WHEN 'Miuref' THEN 4
            WHEN 'Necurs' THEN 5 WHEN 'Trickbot' THEN 6 WHEN 'Upatre' THEN 7 WHEN 'Zeus' THEN 8
            WHEN 'Normal' THEN 9 END AS INTEGER) AS Family_level
FROM labelled"""))
def label_join(spark, sf_dir):
    lab = ds.with_family_order(_labelled(spark, sf_dir))
    return lab.select(*tr.TRACE_KEY, "flowct", "File", "Family", "Type", "Malicious", "Family_level")


@query("drop_captures", "F1", with_ctes(V.LABELLED, f"""
SELECT {_TK}, File FROM labelled WHERE File NOT IN ('traces_3_1.log.csv')"""))
def drop_captures(spark, sf_dir):
    return ds.drop_files(_labelled(spark, sf_dir), ["traces_3_1.log.csv"]).select(*tr.TRACE_KEY, "File")


@query("family_filter", "F2 U1", with_ctes(V.LABELLED, f"""
SELECT {_TK}, Family FROM labelled WHERE Family <> 'Normal' AND Family <> 'Zeus'
UNION ALL SELECT {_TK}, Family FROM labelled WHERE Family = 'Normal'"""))
def family_filter(spark, sf_dir):
    lab = _labelled(spark, sf_dir).select(*tr.TRACE_KEY, "Family")
    mal = lab.where((F.col("Family") != "Normal") & (F.col("Family") != "Zeus"))
    return mal.unionByName(lab.where(F.col("Family") == "Normal"))


_SK = [feature_name(n) for n in SKEWED_FEATURES]


@query("log1p_features", "P7", with_ctes(V.TRACES, f"SELECT {_TK}, " + ", ".join(
    f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" for c in _SK) + " FROM traces"))
def log1p_features(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir))
    return ds.log1p_features(t).select(*tr.TRACE_KEY, *_SK)


@query("recode_label", "P9", with_ctes(V.LABELLED, f"""
SELECT {_TK}, Malicious, CASE WHEN Malicious = 1 THEN 'Yes' ELSE 'No' END AS Malicious_yn,
       CASE WHEN Malicious = 1 THEN 'Malicious' ELSE 'Benign' END AS Malicious_class FROM labelled"""))
def recode_label(spark, sf_dir):
    return ds.recode_label(_labelled(spark, sf_dir)).select(*tr.TRACE_KEY, "Malicious", "Malicious_yn",
                                                            "Malicious_class")


@query("encode_category", "P12", with_ctes(V.TRACES, f"""
SELECT {_TK}, CAST(dense_rank() OVER (ORDER BY protocol) AS INTEGER) AS protocol_code,
       CAST(dense_rank() OVER (ORDER BY destIP) AS INTEGER) AS destIP_code FROM traces"""))
def encode_category(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir)).select(*tr.TRACE_KEY)
    t = ds.encode_category(ds.encode_category(t, "protocol"), "destIP")
    return t.select(*tr.TRACE_KEY, "protocol_code", "destIP_code")


_BCOLS = ", ".join(ly.LAYOUT_B)


@query("complete_cases", "F5", with_ctes(_BIN, f"""
, b AS (SELECT {_K}, any_value(first_p) AS id_orig_p, min(ts) AS ts, count(*) AS flow_ct,
       {", ".join(f"avg({v}) AS mean_{v}, stddev_samp({v}) AS std_{v}" for v in _BV)},
       avg(gap) AS mean_intvl, stddev_pop(gap) AS std_intvl, {_FLAGS_SUM}
     FROM bw GROUP BY {_K})
SELECT {_BCOLS} FROM b WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in ly.LAYOUT_B)).replace("\n, b AS", ", b AS", 1)
       .replace(f"FROM bin)\n, b AS", "FROM bin), b AS"))
def complete_cases(spark, sf_dir):
    return ds.complete_cases(ly.traces_layout_b(fx.flows(spark, sf_dir), exclude_protocols=["icmp"]))


@query("dns_join", "J4", with_ctes(V.FLOWS, """
SELECT f.id_orig_h AS host, d.name, count(*) AS visits
FROM flows f JOIN (SELECT DISTINCT id_orig_h AS host,
                          'host-' || replace(id_orig_h, '.', '-') || '.example.net' AS name
                   FROM flows WHERE CAST(split_part(id_orig_h, '.', 4) AS INTEGER) % 3 = 0) d ON f.id_orig_h = d.host
GROUP BY f.id_orig_h, d.name"""))
def dns_join(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    visits = f.groupBy(F.col("id_orig_h").alias("host")).agg(F.count(F.lit(1)).alias("visits"))
    return visits.join(fx.dns_names(f), "host").select("host", "name", "visits")


# --- profiles -------------------------------------------------------------

from flowtrace.operators import profile as pf  # noqa: E402

_METRICS = ["flowct", "mean_duration", "mean_intvl", "mean_src_pkts", "mean_dest_bytes"]
_LONG_T = " UNION ALL ".join(
    f"SELECT {_TK}, Malicious, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM labelled" for m in _METRICS)


@query("family_summary", "A13 F2", with_ctes(V.LABELLED, """
SELECT Family, """ + ", ".join(
    f"quantile_cont({m}, 0.5) AS median_{m}, stddev_samp({m}) AS sd_{m}"
    for m in ["flowct", "mean_duration", "mean_src_pkts"]) + """
FROM labelled WHERE Family <> 'Normal' GROUP BY Family"""))
def family_summary(spark, sf_dir):
    mal = _labelled(spark, sf_dir).where(F.col("Family") != "Normal")
    return pf.group_summary(mal, "Family", ["flowct", "mean_duration", "mean_src_pkts"])


_VC = ["id_resp_h", "id_resp_p", "id_orig_h", "id_orig_p"]


@query("value_counts", "A14 O2", with_ctes(V.FLOWS, " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM flows GROUP BY {c}" for c in _VC)))
def value_counts(spark, sf_dir):
    return pf.value_counts(fx.flows(spark, sf_dir), _VC)


@query("top_sources", "O3 O2", with_ctes(V.FLOWS, """
SELECT id_orig_h, count(*) AS n FROM flows GROUP BY id_orig_h ORDER BY n DESC, id_orig_h LIMIT 100"""))
def top_sources(spark, sf_dir):
    return pf.top_values(fx.flows(spark, sf_dir), "id_orig_h", 100)


_NA = ["ts", "uid", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "service", "duration",
       "orig_bytes", "resp_bytes", "conn_state", "history", "orig_pkts", "resp_pkts"]


@query("null_audit", "A15", with_ctes(V.FLOWS, " UNION ALL ".join(
    f"SELECT '{c}' AS field, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing FROM flows" for c in _NA)))
def null_audit(spark, sf_dir):
    return pf.null_audit(fx.flows(spark, sf_dir), _NA)


@query("quantiles", "A16", with_ctes(V.TRACES, " UNION ALL ".join(
    f"SELECT '{m}' AS metric, " + ", ".join(
        f"quantile_cont(CAST({m} AS DOUBLE), {p}) AS q{n}" for p, n in
        [(0.0, 0), (0.25, 25), (0.5, 50), (0.75, 75), (1.0, 100)]) + " FROM traces" for m in _METRICS)))
def quantiles(spark, sf_dir):
    return pf.five_numbers(_traces(spark, sf_dir), _METRICS)


@query("box_stats", "A17", with_ctes(V.LABELLED + f""",
long AS ({_LONG_T}),
q AS (SELECT metric, Malicious, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY metric, Malicious)""", """
SELECT q.metric, q.Malicious, q.q1, q.median, q.q3, q.q3 - q.q1 AS iqr,
       min(CASE WHEN l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END) AS lower_whisker,
       max(CASE WHEN l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1) THEN l.value END) AS upper_whisker,
       CAST(count_if(NOT (l.value BETWEEN q.q1 - 1.5 * (q.q3 - q.q1) AND q.q3 + 1.5 * (q.q3 - q.q1))) AS BIGINT) AS n_outliers,
       count(*) AS n
FROM q JOIN long l USING (metric, Malicious)
GROUP BY q.metric, q.Malicious, q.q1, q.median, q.q3"""))
def box_stats(spark, sf_dir):
    return pf.box_stats(_labelled(spark, sf_dir), _METRICS, "Malicious")


@query("class_means", "A18", with_ctes(V.LABELLED, "SELECT Malicious, " + ", ".join(
    f"avg({m}) AS mean_{m}" for m in _METRICS) + " FROM labelled GROUP BY Malicious"))
def class_means(spark, sf_dir):
    return pf.class_means(_labelled(spark, sf_dir), _METRICS, "Malicious")


@query("contingency", "A19", with_ctes(V.LABELLED, """
SELECT f.Family, p.protocol, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT Family FROM labelled) f CROSS JOIN (SELECT DISTINCT protocol FROM labelled) p
LEFT JOIN (SELECT Family, protocol, count(*) AS n FROM labelled GROUP BY Family, protocol) c
  ON c.Family = f.Family AND c.protocol = p.protocol"""))
def contingency(spark, sf_dir):
    return pf.contingency(_labelled(spark, sf_dir), "Family", "protocol")


@query("below_p90", "F4", with_ctes(V.LABELLED + f""",
long AS ({_LONG_T}),
q AS (SELECT metric, quantile_cont(value, 0.9) AS q FROM long GROUP BY metric)""", f"""
SELECT {_TK}, metric, value FROM long JOIN q USING (metric) WHERE value < q"""))
def below_p90(spark, sf_dir):
    return pf.below_quantile(_labelled(spark, sf_dir), _METRICS, tr.TRACE_KEY, 0.9)


@query("upper_bound", "F3", with_ctes(V.TRACES, f"SELECT {_TK}, mean_intvl FROM traces WHERE mean_intvl < 30000"))
def upper_bound(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir))
    return t.where(F.col("mean_intvl") < 30000).select(*tr.TRACE_KEY, "mean_intvl")


@query("first_rows", "O5", with_ctes(V.FLOWS + "," + _IDS_SQL, f"""
SELECT i.trace_id, f.uid, f.ts FROM flows f JOIN ids i USING ({_K}) ORDER BY i.trace_id, f.ts, f.uid LIMIT 30"""))
def first_rows(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    j = fl.flows_with_ids(f, fl.trace_ids(f)).select("trace_id", "uid", "ts")
    return j.orderBy("trace_id", "ts", "uid").limit(30)


@query("sorted_flows", "O1", with_ctes(V.FLOWS + "," + _IDS_SQL, f"""
SELECT i.trace_id, f.uid, f.ts FROM flows f JOIN ids i USING ({_K}) ORDER BY i.trace_id, f.ts, f.uid"""))
def sorted_flows(spark, sf_dir):
    f = fx.flows(spark, sf_dir)
    return fl.flows_with_ids(f, fl.trace_ids(f)).select("trace_id", "uid", "ts").orderBy("trace_id", "ts", "uid")


# --- splits ---------------------------------------------------------------

from flowtrace.operators import splits as sp  # noqa: E402
from flowtrace.schema import MALWARE_FAMILIES  # noqa: E402

_RID = "concat_ws('|', srcIP, destIP, CAST(destPt AS VARCHAR), protocol)"
_LAB_IDS = V.LABELLED + f""",
lab AS (SELECT {_RID} AS row_id, Family, Malicious, flowct FROM labelled)"""
_MD5 = "md5('11|' || row_id)"


def _lab_ids(spark, sf_dir):
    return sp.with_id(_labelled(spark, sf_dir), tr.TRACE_KEY).select("row_id", "Family", "Malicious", "flowct")


@query("split_fixed", "M1 J5 J6", with_ctes(_LAB_IDS, f"""
SELECT row_id, CASE WHEN row_number() OVER (ORDER BY {_MD5}) <= 1000 THEN 'train' ELSE 'test' END AS part FROM lab"""))
def split_fixed(spark, sf_dir):
    lab = _lab_ids(spark, sf_dir)
    s = sp.split_fixed(lab, "row_id", 1000)
    train = sp.sample_rows(lab, s.where(F.col("part") == "train"), "row_id")
    test = sp.rest_rows(lab, train, "row_id")
    return (train.select("row_id", F.lit("train").alias("part"))
            .unionByName(test.select("row_id", F.lit("test").alias("part"))))


@query("split_fraction", "M2", with_ctes(_LAB_IDS, f"""
SELECT row_id, CASE WHEN substr({_MD5}, 1, 8) < 'b3333334' THEN 'train' ELSE 'test' END AS part FROM lab"""))
def split_fraction(spark, sf_dir):
    return sp.split_fraction(_lab_ids(spark, sf_dir), "row_id", 0.7).select("row_id", "part")


_FAMS = ", ".join(f"'{f}'" for f in MALWARE_FAMILIES)


@query("leave_family_out", "M3", with_ctes(_LAB_IDS + f""",
nr AS (SELECT row_id, row_number() OVER (ORDER BY {_MD5}) AS nrank FROM lab WHERE Family = 'Normal'),
fc AS (SELECT Family AS fold_family, count(*) AS nf FROM lab WHERE Family IN ({_FAMS}) GROUP BY Family),
folds AS (SELECT unnest([{_FAMS}]) AS fold_family)""", """
SELECT l.row_id, l.Family, f.fold_family,
       CASE WHEN l.Family = f.fold_family OR (l.Family = 'Normal' AND nr.nrank <= coalesce(fc.nf, 0))
            THEN 'test' ELSE 'train' END AS part
FROM lab l CROSS JOIN folds f LEFT JOIN nr ON nr.row_id = l.row_id LEFT JOIN fc ON fc.fold_family = f.fold_family"""))
def leave_family_out(spark, sf_dir):
    lf = sp.leave_family_out(_lab_ids(spark, sf_dir), "row_id", MALWARE_FAMILIES)
    return lf.select("row_id", "Family", "fold_family", "part")


@query("oversample", "M4", with_ctes(_LAB_IDS + """,
cc AS (SELECT Malicious, count(*) AS c FROM lab GROUP BY Malicious),
mn AS (SELECT Malicious AS m FROM cc ORDER BY c, Malicious LIMIT 1)""", """
SELECT row_id, Malicious, CAST(unnest(generate_series(1, CASE WHEN Malicious = (SELECT m FROM mn) THEN 160 ELSE 1 END)) AS INTEGER) AS copy
FROM lab"""))
def oversample(spark, sf_dir):
    return sp.oversample(_lab_ids(spark, sf_dir), "Malicious", 160).select("row_id", "Malicious", "copy")


@query("undersample", "M5", with_ctes(_LAB_IDS + """,
cc AS (SELECT Malicious, count(*) AS c FROM lab GROUP BY Malicious),
mj AS (SELECT Malicious AS m FROM cc ORDER BY c DESC, Malicious LIMIT 1)""", f"""
SELECT row_id, Malicious FROM lab
WHERE Malicious <> (SELECT m FROM mj) OR substr({_MD5}, 1, 8) < '{math.ceil(2 ** 32 / 160):08x}'"""))
def undersample(spark, sf_dir):
    return sp.undersample(_lab_ids(spark, sf_dir), "Malicious", "row_id", 1 / 160).select("row_id", "Malicious")


@query("cv_folds", "M6", with_ctes(_LAB_IDS, f"""
SELECT CAST(('0x' || substr({_MD5}, 1, 8))::UBIGINT % 10 AS INTEGER) AS fold, count(*) AS n FROM lab GROUP BY 1"""))
def cv_folds(spark, sf_dir):
    return sp.cv_folds(_lab_ids(spark, sf_dir), "row_id", 10).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# --- evaluation -----------------------------------------------------------

from flowtrace.operators import evaluate as ev  # noqa: E402
from flowtrace.operators import lasso as ls  # noqa: E402

_SCORED = """
scored AS (SELECT l.doc_id, CAST(l.toxic AS INTEGER) AS label, CAST(d.n_chars AS DOUBLE) AS score,
                  CASE WHEN CAST(d.n_chars AS DOUBLE) > 2000 THEN 1 ELSE 0 END AS pred
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
_COUNTS = _SCORED + """,
cnt AS (SELECT CAST(count_if(pred = 1 AND label = 1) AS BIGINT) AS tp,
               CAST(count_if(pred = 1 AND label <> 1) AS BIGINT) AS fp,
               CAST(count_if(pred <> 1 AND label = 1) AS BIGINT) AS fn,
               CAST(count_if(pred <> 1 AND label <> 1) AS BIGINT) AS tn FROM scored)"""
_MEASURES = """
  CAST(tp + tn AS DOUBLE) / NULLIF(tp + fp + fn + tn, 0) AS accuracy,
  CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS sensitivity, CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0) AS specificity,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS ppv, CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0) AS npv,
  CAST(tp + fn AS DOUBLE) / NULLIF(tp + fp + fn + tn, 0) AS prevalence,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp + fn + tn, 0) AS detection_rate,
  CAST(tp + fp AS DOUBLE) / NULLIF(tp + fp + fn + tn, 0) AS detection_prevalence,
  (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) + CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)) / 2 AS balanced_accuracy,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
  2 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0))
    / NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS f1"""


def _scored(spark, sf_dir):
    return ev.predict_at(fx.scored_documents(spark, sf_dir), "score", 2000.0)


@query("confusion", "E1 P13", with_ctes(_COUNTS, f"SELECT tp, fp, fn, tn, {_MEASURES} FROM cnt"))
def confusion(spark, sf_dir):
    return ev.confusion_measures(ev.confusion_counts(_scored(spark, sf_dir)))


@query("agreement", "E2", with_ctes(_COUNTS, """
SELECT tp, fp, fn, tn,
  ((CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn))
   - (CAST((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) AS DOUBLE) / ((tp + fp + fn + tn) * CAST(tp + fp + fn + tn AS DOUBLE))))
  / NULLIF(1 - (CAST((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) AS DOUBLE) / ((tp + fp + fn + tn) * CAST(tp + fp + fn + tn AS DOUBLE))), 0) AS kappa,
  CAST(greatest(tp + fn, fp + tn) AS DOUBLE) / (tp + fp + fn + tn) AS nir,
  power(abs(fp - fn) - 1, 2) / NULLIF(CAST(fp + fn AS DOUBLE), 0) AS mcnemar_chi2
FROM cnt"""))
def agreement(spark, sf_dir):
    return ev.agreement(ev.confusion_counts(_scored(spark, sf_dir)))


@query("agreement_tests", "E2 (exact interval, binomial and McNemar tails)")
def agreement_tests(spark, sf_dir):
    return ev.with_tests(ev.agreement(ev.confusion_counts(_scored(spark, sf_dir))))


@query("ppv_npv", "E3", with_ctes(_COUNTS + f""",
m AS (SELECT {_MEASURES} FROM cnt)""", "SELECT ppv, npv, ppv * npv / NULLIF(ppv + npv, 0) AS ppv_npv FROM m"))
def ppv_npv(spark, sf_dir):
    m = ev.confusion_measures(ev.confusion_counts(_scored(spark, sf_dir)))
    return ev.ppv_npv_score(m).select("ppv", "npv", "ppv_npv")


_SC = _SCORED + """,
sc AS (SELECT score, CAST(count_if(label = 1) AS DOUBLE) AS pos, CAST(count_if(label <> 1) AS DOUBLE) AS neg
       FROM scored GROUP BY score)"""


@query("roc_points", "E4", with_ctes(_SC, """
SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(pos) OVER () AS tpr,
       sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(neg) OVER () AS fpr
FROM sc"""))
def roc_points(spark, sf_dir):
    return ev.roc_points(_scored(spark, sf_dir))


_AUC_SQL = """
SELECT sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc
FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sc)"""


@query("auc", "E5", with_ctes(_SC, _AUC_SQL))
def auc(spark, sf_dir):
    return ev.auc(_scored(spark, sf_dir))


@query("error_rates", "E6", with_ctes(_COUNTS + """,
sc AS (SELECT score, CAST(count_if(label = 1) AS DOUBLE) AS pos, CAST(count_if(label <> 1) AS DOUBLE) AS neg
       FROM scored GROUP BY score),
a AS (""" + _AUC_SQL + ")", """
SELECT 1 - CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS mmce,
       1 - (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) + CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)) / 2 AS ber, a.auc
FROM cnt, a"""))
def error_rates(spark, sf_dir):
    return ev.error_rates(_scored(spark, sf_dir))


_LOO_SCORED = _LAB_IDS + f""",
nr AS (SELECT row_id, row_number() OVER (ORDER BY {_MD5}) AS nrank FROM lab WHERE Family = 'Normal'),
fc AS (SELECT Family AS fold_family, count(*) AS nf FROM lab WHERE Family IN ({_FAMS}) GROUP BY Family),
folds AS (SELECT unnest([{_FAMS}]) AS fold_family),
parts AS (SELECT l.row_id, l.Malicious AS label, CAST(l.flowct AS DOUBLE) AS score,
                 CASE WHEN l.flowct > 6 THEN 1 ELSE 0 END AS pred, f.fold_family,
                 CASE WHEN l.Family = f.fold_family OR (l.Family = 'Normal' AND nr.nrank <= coalesce(fc.nf, 0))
                      THEN 'test' ELSE 'train' END AS part
          FROM lab l CROSS JOIN folds f LEFT JOIN nr ON nr.row_id = l.row_id
          LEFT JOIN fc ON fc.fold_family = f.fold_family),
t AS (SELECT * FROM parts WHERE part = 'test'),
cnt AS (SELECT fold_family, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label <> 1) AS fp,
               count_if(pred <> 1 AND label = 1) AS fn, count_if(pred <> 1 AND label <> 1) AS tn
        FROM t GROUP BY fold_family),
sc AS (SELECT fold_family, score, CAST(count_if(label = 1) AS DOUBLE) AS pos,
              CAST(count_if(label <> 1) AS DOUBLE) AS neg FROM t GROUP BY fold_family, score),
a AS (SELECT fold_family, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT fold_family, pos, neg, sum(neg) OVER (PARTITION BY fold_family ORDER BY score
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sc) GROUP BY fold_family)"""


def _loo_test_scored(spark, sf_dir):
    # test rows only, each once for every family that tests it: no row is copied for the folds it trains
    rows, sizes = ls.with_bands(_lab_ids(spark, sf_dir), "row_id", MALWARE_FAMILIES)
    t = rows.select("row_id", F.explode(ls.tested_with(sizes)).alias("fold_family"), F.col("Malicious").alias("label"),
                    F.col("flowct").cast("double").alias("score"))
    return ev.predict_at(t, "score", 6.0)


@query("family_metrics", "E7 U2", with_ctes(_LOO_SCORED, """
SELECT c.fold_family,
  (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) + CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)) / 2 AS balanced_accuracy,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
  2 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0))
    / NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS F1Score,
  a.auc
FROM cnt c JOIN a ON a.fold_family = c.fold_family"""))
def family_metrics(spark, sf_dir):
    return ev.metric_table(_loo_test_scored(spark, sf_dir), ["fold_family"])


@query("predict_by_family", "P13 (a cut for each family from its ROC points, joined back; strict >)", with_ctes(_LOO_SCORED + """,
tot AS (SELECT fold_family, sum(pos) AS P, sum(neg) AS N FROM sc GROUP BY fold_family),
roc AS (SELECT sc.fold_family, score, sum(pos) OVER w / P - sum(neg) OVER w / N AS gain, lead(score) OVER w AS below
        FROM sc JOIN tot ON tot.fold_family = sc.fold_family WINDOW w AS (PARTITION BY sc.fold_family ORDER BY score DESC)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_family ORDER BY gain DESC, score DESC) AS r FROM roc) WHERE r = 1),
cuts AS (SELECT fold_family, coalesce((score + below) / 2, '-inf'::DOUBLE) AS cut FROM best)""", """
SELECT t.fold_family, max(c.cut) AS cut, count_if(t.score > c.cut AND label = 1) AS tp, count_if(t.score > c.cut AND label <> 1) AS fp,
  count_if(t.score <= c.cut AND label = 1) AS fn, count_if(t.score <= c.cut AND label <> 1) AS tn
FROM t JOIN cuts c ON c.fold_family = t.fold_family GROUP BY t.fold_family"""))
def predict_by_family(spark, sf_dir):
    scored = _loo_test_scored(spark, sf_dir)
    cuts = ev.best_cuts(scored, ["fold_family"])
    pred = ev.predict_by_group(scored, cuts, ["fold_family"])
    return ev.confusion_counts(pred, group=["fold_family"]).join(cuts, "fold_family").select("fold_family", "cut", "tp", "fp", "fn", "tn")


@query("auc_by_params", "E8", with_ctes(_SCORED + """,
g AS (SELECT d.lang, s.score, s.label FROM scored s JOIN documents d ON d.doc_id = s.doc_id),
sc AS (SELECT lang, score, CAST(count_if(label = 1) AS DOUBLE) AS pos, CAST(count_if(label <> 1) AS DOUBLE) AS neg
       FROM g GROUP BY lang, score)""", """
SELECT lang, sum(pos * (cn - neg / 2)) / NULLIF(sum(pos) * sum(neg), 0) AS auc
FROM (SELECT lang, pos, neg, sum(neg) OVER (PARTITION BY lang ORDER BY score
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sc) GROUP BY lang"""))
def auc_by_params(spark, sf_dir):
    s = fx.scored_documents(spark, sf_dir).join(
        fx.read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return ev.auc(s, group=["lang"])


_TWO_MODELS = _SCORED + """,
m AS (SELECT doc_id, label, score AS chars, CAST(doc_id % 97 AS DOUBLE) AS idmod FROM scored)"""


def _two_models(spark, sf_dir):
    s = fx.scored_documents(spark, sf_dir)
    return {"chars": s.select("doc_id", "label", F.col("score").alias("prob")),
            "idmod": s.select("doc_id", "label", (F.col("doc_id") % 97).cast("double").alias("prob"))}


@query("merge_predictions", "J2 R2", with_ctes(_TWO_MODELS, "SELECT doc_id, label, chars, idmod FROM m"))
def merge_predictions(spark, sf_dir):
    return ev.merge_predictions(_two_models(spark, sf_dir), ["doc_id", "label"])


@query("roc_long", "E9 R1", with_ctes(_TWO_MODELS + """,
long AS (SELECT doc_id, label, 'chars' AS model, chars AS prob FROM m
         UNION ALL SELECT doc_id, label, 'idmod' AS model, idmod AS prob FROM m),
sc AS (SELECT model, prob AS score, CAST(count_if(label = 1) AS DOUBLE) AS pos,
              CAST(count_if(label <> 1) AS DOUBLE) AS neg FROM long GROUP BY model, prob)""", """
SELECT model, score,
  sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(pos) OVER (PARTITION BY model) AS tpr,
  sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(neg) OVER (PARTITION BY model) AS fpr
FROM sc"""))
def roc_long(spark, sf_dir):
    wide = ev.merge_predictions(_two_models(spark, sf_dir), ["doc_id", "label"])
    long = ev.melt(wide, ["doc_id", "label"], ["chars", "idmod"])
    return ev.roc_points(long, "label", "prob", group=["model"])


# --- features and models --------------------------------------------------

from flowtrace.operators import models as ml  # noqa: E402
from flowtrace.schema import NB_DROPPED_FLAGS  # noqa: E402

_NB_FEATS = ["flowct", "mean_duration", "mean_src_pkts", "mean_dest_bytes", "mean_intvl"]


@query("center", "L1", with_ctes(V.TRACES, f"SELECT {_TK}, " + ", ".join(
    f"CAST({m} AS DOUBLE) - avg(CAST({m} AS DOUBLE)) OVER () AS {m}" for m in _METRICS) + " FROM traces"))
def center(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir)).select(*tr.TRACE_KEY, *[F.col(m).cast("double").alias(m)
                                                                         for m in _METRICS])
    return ml.center(t, _METRICS)


@query("range_scale", "L2", with_ctes(V.TRACES, f"SELECT {_TK}, " + ", ".join(
    f"CASE WHEN max({m}) OVER () = min({m}) OVER () THEN 0.5 ELSE (CAST({m} AS DOUBLE) - min({m}) OVER ()) "
    f"/ (max({m}) OVER () - min({m}) OVER ()) END AS {m}" for m in _METRICS) + " FROM traces"))
def range_scale(spark, sf_dir):
    t = tr.conn_traces(fx.flows(spark, sf_dir)).select(*tr.TRACE_KEY, *[F.col(m).cast("double").alias(m)
                                                                         for m in _METRICS])
    return ml.range_scale(t, _METRICS)


_BC_COLS = ["flowct", "mean_src_pkts", "mean_dest_bytes", "mean_duration", "mean_intvl"]
_LAMS = ", ".join(repr(x) for x in ml.LAMBDA_GRID)


@query("box_cox", "L3", with_ctes(V.TRACES + """,
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS DOUBLE) AS x FROM traces" for c in _BC_COLS)
                                  + f"""),
lams AS (SELECT unnest([{_LAMS}]::DOUBLE[]) AS lam),
per AS (SELECT field, lam, count(*) AS n,
               var_pop(CASE WHEN x <= 0 THEN NULL WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1) / lam END) AS v,
               sum(CASE WHEN x > 0 THEN ln(x) END) AS slx, min(x) AS xmin
        FROM long CROSS JOIN lams WHERE x IS NOT NULL GROUP BY field, lam),
sc AS (SELECT field, lam AS bc_lambda, -n / 2.0 * ln(v) + (lam - 1) * slx AS loglik
       FROM per WHERE xmin > 0)""", "SELECT field, arg_max(bc_lambda, loglik) AS bc_lambda, max(loglik) AS loglik FROM sc GROUP BY field"))
def box_cox(spark, sf_dir):
    return ml.box_cox_lambdas(_traces(spark, sf_dir), _BC_COLS)


def _model_table(spark, sf_dir, folds: int = 3):
    """Labelled, log-transformed trace features with split and fold columns.

    Model fits pass over their input many times (one job per iteration), so
    the table is materialised once (reliable checkpoint: lineage cut, survives
    executor loss).  Traces without a label teach nothing and are left out.
    """
    lab = sp.with_id(_labelled(spark, sf_dir), tr.TRACE_KEY)
    lab = ds.log1p_features(lab)
    lab = lab.withColumn("label", F.col("Malicious").cast("double"))
    lab = sp.split_fraction(lab, "row_id", 0.7)
    lab = sp.cv_folds(lab, "row_id", folds).select("row_id", "Family", "Malicious", "label", "part", "fold", *_SK)
    return lab.where("label IS NOT NULL").checkpoint(eager=True)


_NB_TRAIN = V.LABELLED + f""",
lab AS (SELECT {_RID} AS row_id, Malicious AS label, """ + ", ".join(
    f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" for c in _NB_FEATS) + f""" FROM labelled),
parts AS (SELECT *, CASE WHEN substr({_MD5}, 1, 8) < 'b3333334' THEN 'train' ELSE 'test' END AS part FROM lab),
st AS (SELECT label AS c, count(*) AS n, """ + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 AS v_{c}" for c in _NB_FEATS) + """
       FROM parts WHERE part = 'train' GROUP BY label),
tot AS (SELECT sum(n) AS total FROM st),
lp AS (SELECT p.row_id, s.c, ln(s.n / tot.total) """ + " ".join(
    f"- 0.5 * ln(2 * pi() * s.v_{c}) - power(p.{c} - s.m_{c}, 2) / (2 * s.v_{c})" for c in _NB_FEATS) + """ AS lp
       FROM parts p, st s, tot WHERE p.part = 'test'),
w AS (SELECT row_id, max(CASE WHEN c = 1 THEN lp END) AS l1, max(CASE WHEN c = 0 THEN lp END) AS l0
      FROM lp GROUP BY row_id)"""


@query("gaussian_nb", "L9 L15", with_ctes(_NB_TRAIN, """
SELECT row_id, exp(l1 - greatest(l1, l0)) / (exp(l1 - greatest(l1, l0)) + exp(l0 - greatest(l1, l0))) AS prob FROM w"""))
def gaussian_nb(spark, sf_dir):
    lab = ds.log1p_features(sp.with_id(_labelled(spark, sf_dir), tr.TRACE_KEY), _NB_FEATS)
    lab = sp.split_fraction(lab.withColumn("label", F.col("Malicious")), "row_id", 0.7)
    model = ml.gaussian_nb_fit(lab.where(F.col("part") == "train"), _NB_FEATS, "label")
    return ml.gaussian_nb_score(lab.where(F.col("part") == "test"), model, _NB_FEATS).select("row_id", "prob")


@query("kernel_nb_scores", "L9 (kernel form: per-class histogram densities)")
def kernel_nb_scores(spark, sf_dir):
    t = _model_table(spark, sf_dir)
    feats = [f for f in _SK if f not in {feature_name(c) for c in NB_DROPPED_FLAGS}]
    s = ml.histogram_nb_grouped(t.where(F.col("part") == "train"), t.where(F.col("part") == "test"), feats,
                                label="label", positive=1.0)
    return s.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def _train_test(spark, sf_dir):
    t = _model_table(spark, sf_dir)
    return t.where(F.col("part") == "train"), t.where(F.col("part") == "test")


@query("rf_scores", "L4 L15 P15")
def rf_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    scored, _ = ml.random_forest(train, test, _SK, num_trees=30, fold_col="fold", subsets=["2", "6", "13", "26"])
    return scored


@query("cv_predictions", "M6 F7 P15 (out-of-fold predictions, one setting kept)")
def cv_predictions(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)

    def make(mtry, ntree):
        return ml.forest(numTrees=ntree, featureSubsetStrategy=str(mtry), maxDepth=12, seed=11)

    preds = ml.cv_predictions(train, _SK, [{"mtry": 2, "ntree": 20}, {"mtry": 6, "ntree": 20}], make)
    return preds.where(F.col("mtry") == 6)


@query("rf_grid", "L5 J7 O6")
def rf_grid(spark, sf_dir):
    """Cross-validated AUC of every (mtry, ntree) setting, sorted by mtry."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    train, _ = _train_test(spark, sf_dir)
    rf = ml.forest(maxDepth=12, seed=11)
    grid = (ParamGridBuilder().addGrid(rf.featureSubsetStrategy, ["2", "6", "26"])
            .addGrid(rf.numTrees, [20, 50]).build())
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, foldCol="fold", parallelism=ml.PARALLEL_FITS,
                        evaluator=BinaryClassificationEvaluator(labelCol="label"))
    model = cv.fit(ml.assemble(train, _SK))
    rows = [(int(pm[rf.featureSubsetStrategy]), int(pm[rf.numTrees]), float(m))
            for pm, m in zip(grid, model.avgMetrics)]
    return spark.createDataFrame(rows, "mtry int, ntree int, cv_auc double").orderBy("mtry", "ntree")


@query("lasso_scores", "L6")
def lasso_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return ml.lasso_linear(train, test, _SK)[0]


@query("logistic_scores", "L7")
def logistic_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return ml.logistic(train, test, _SK)[0]


@query("rbf_svm_scores", "L8")
def rbf_svm_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return ml.rbf_svm(train, test, _SK)[0]


@query("mlp_scores", "L10")
def mlp_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return ml.mlp(train, test, _SK)[0]


@query("tree_scores", "L11")
def tree_scores(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    return ml.decision_tree(train, test, _SK)[0]


_GLM_FEATS = ["flowct", "mean_duration", "mean_src_pkts", "mean_dest_bytes", "mean_intvl", "src_S", "dest_d"]


@query("stepwise", "L12")
def stepwise(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)
    rows = ml.stepwise_aic(train, _GLM_FEATS, "label")
    return spark.createDataFrame(rows, "step int, action string, term string, aic double")


@query("deviance_test", "L13")
def deviance_test(spark, sf_dir):
    train, _ = _train_test(spark, sf_dir)
    rows = ml.deviance_table(train, _GLM_FEATS, "label")
    return spark.createDataFrame(rows, "term string, df int, deviance double, resid_dev double, p double")


@query("importance_top25", "L14 O4 R4")
def importance_top25(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    _, model = ml.random_forest(train, test, _SK, num_trees=30)
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(_SK, imp), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(25)


from flowtrace.plans.loo import FEATURES as _LOO_ALL  # noqa: E402

_LOO_NB = [f for f in _LOO_ALL if f not in {feature_name(c) for c in NB_DROPPED_FLAGS}]
_LOO_SQL = V.LABELLED + f""",
lab AS (SELECT {_RID} AS row_id, Family, Malicious AS label, """ + ", ".join(
    f"ln(1 + CAST({c} AS DOUBLE)) AS {c}" for c in _LOO_NB) + f""" FROM labelled),
nr AS (SELECT row_id, row_number() OVER (ORDER BY {_MD5}) AS nrank FROM lab WHERE Family = 'Normal'),
fc AS (SELECT Family AS fold_family, count(*) AS nf FROM lab WHERE Family IN ({_FAMS}) GROUP BY Family),
folds AS (SELECT unnest([{_FAMS}]) AS fold_family),
parts AS (SELECT l.*, f.fold_family,
                 CASE WHEN l.Family = f.fold_family OR (l.Family = 'Normal' AND nr.nrank <= coalesce(fc.nf, 0))
                      THEN 'test' ELSE 'train' END AS part
          FROM lab l CROSS JOIN folds f LEFT JOIN nr ON nr.row_id = l.row_id
          LEFT JOIN fc ON fc.fold_family = f.fold_family),
st AS (SELECT fold_family, label AS c, count(*) AS n, """ + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) + 1e-9 AS v_{c}" for c in _LOO_NB) + """
       FROM parts WHERE part = 'train' GROUP BY fold_family, label),
pri AS (SELECT *, ln(n / sum(n) OVER (PARTITION BY fold_family)) AS lp0 FROM st),
lp AS (SELECT p.fold_family, p.row_id, p.label AS obs, s.c, s.lp0 """ + " ".join(
    f"+ (-0.5 * ln(2 * pi() * s.v_{c}) - power(p.{c} - s.m_{c}, 2) / (2 * s.v_{c}))" for c in _LOO_NB) + """ AS lp
       FROM parts p JOIN pri s ON s.fold_family = p.fold_family WHERE p.part = 'test'),
w AS (SELECT fold_family, row_id, max(lp) AS mx FROM lp GROUP BY fold_family, row_id),
pr AS (SELECT lp.fold_family, lp.row_id, any_value(lp.obs) AS obs,
              sum(CASE WHEN lp.c = 1 THEN exp(lp.lp - w.mx) ELSE 0 END) / sum(exp(lp.lp - w.mx)) AS prob
       FROM lp JOIN w ON w.fold_family = lp.fold_family AND w.row_id = lp.row_id
       GROUP BY lp.fold_family, lp.row_id),
t AS (SELECT fold_family, obs AS label, prob AS score, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM pr),
cnt AS (SELECT fold_family, count_if(pred = 1 AND label = 1) AS tp, count_if(pred = 1 AND label <> 1) AS fp,
               count_if(pred <> 1 AND label = 1) AS fn, count_if(pred <> 1 AND label <> 1) AS tn
        FROM t GROUP BY fold_family),
sc AS (SELECT fold_family, score, CAST(count_if(label = 1) AS DOUBLE) AS pos,
              CAST(count_if(label <> 1) AS DOUBLE) AS neg FROM t GROUP BY fold_family, score),
a AS (SELECT fold_family, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT fold_family, pos, neg, sum(neg) OVER (PARTITION BY fold_family ORDER BY score
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM sc) GROUP BY fold_family)"""


@query("loo_run", "L16 L9 M3 E7 U2", with_ctes(_LOO_SQL, """
SELECT c.fold_family AS family,
  (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) + CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0)) / 2 AS balanced_accuracy,
  CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall,
  2 * (CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0)) * (CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0))
    / NULLIF(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) + CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0) AS F1Score,
  a.auc
FROM cnt c JOIN a ON a.fold_family = c.fold_family"""))
def loo_run(spark, sf_dir):
    from flowtrace.plans.loo import leave_one_family_out
    return leave_one_family_out(_model_table(spark, sf_dir), model="nb")


# --- naive Bayes with smooth kernels --------------------------------------

from flowtrace.operators import kernel_nb as kn  # noqa: E402

#: naive Bayes has its features as they are, without the flags that no flow sets
_KERNEL_FEATS = [c for c in TRACE_COLUMNS_A[5:] if c not in {feature_name(x) for x in NB_DROPPED_FLAGS}]
_KERNEL_SQL = V.LABELLED + f""",
lab AS (SELECT {_RID} AS row_id, Malicious AS label, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _KERNEL_FEATS)} FROM labelled),
parts AS (SELECT *, CASE WHEN substr({_MD5}, 1, 8) < 'b3333334' THEN 'train' ELSE 'test' END AS part FROM lab),
long AS ({" UNION ALL ".join(f"SELECT row_id, label, part, '{c}' AS feature, {c} AS x FROM parts" for c in _KERNEL_FEATS)}),
tr AS (SELECT * FROM long WHERE part = 'train'),
st AS (SELECT label, feature, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd, min(x) AS a, max(x) AS b,
              quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM tr GROUP BY label, feature),
bw AS (SELECT *, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd WHEN abs(a) > 0 THEN abs(a) ELSE 1.0 END
              * power(n, -0.2) AS h FROM st),
gr AS (SELECT *, a - 3 * h AS low, (b - a + 6 * h) / {kn.GRID - 1} AS step FROM bw),
us AS (SELECT t.label, t.feature, (t.x - g.low) / g.step AS u FROM tr t JOIN gr g ON g.label = t.label AND g.feature = t.feature),
bins AS (SELECT label, feature, CAST(floor(u) AS INTEGER) AS i, count(*) AS c, sum(u - floor(u)) AS up FROM us GROUP BY 1, 2, 3),
mass AS (SELECT label, feature, i, sum(m) AS m FROM (SELECT label, feature, i, c - up AS m FROM bins
         UNION ALL SELECT label, feature, i + 1 AS i, up AS m FROM bins) GROUP BY label, feature, i),
dens AS (SELECT g.label, g.feature, p.j, sum(m.m * exp(-0.5 * power((p.j - m.i) * g.step / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())) AS d
         FROM gr g JOIN mass m ON m.label = g.label AND m.feature = g.feature CROSS JOIN (SELECT unnest(range({kn.GRID})) AS j) p
         GROUP BY g.label, g.feature, p.j, g.n, g.h),
te AS (SELECT l.row_id, g.label AS c, l.feature, (l.x - g.low) / g.step AS u FROM long l JOIN gr g ON g.feature = l.feature WHERE l.part = 'test'),
lp AS (SELECT te.row_id, te.c, sum(ln(greatest(CASE WHEN u >= 0 AND u <= {kn.GRID - 1}
              THEN coalesce(d0.d, 0) * (1 - (u - floor(u))) + coalesce(d1.d, 0) * (u - floor(u)) ELSE 0 END, {kn.FLOOR}))) AS l
       FROM te LEFT JOIN dens d0 ON d0.label = te.c AND d0.feature = te.feature AND d0.j = floor(u)
               LEFT JOIN dens d1 ON d1.label = te.c AND d1.feature = te.feature AND d1.j = floor(u) + 1 GROUP BY te.row_id, te.c),
pr AS (SELECT label, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM parts WHERE part = 'train')) AS p FROM parts WHERE part = 'train' GROUP BY label),
w AS (SELECT lp.row_id, max(CASE WHEN lp.c = 1 THEN l + pr.p END) AS l1, max(CASE WHEN lp.c = 0 THEN l + pr.p END) AS l0
      FROM lp JOIN pr ON pr.label = lp.c GROUP BY lp.row_id)"""


@query("kernel_nb", "L9 L15 (Gaussian kernels by binning, density arrays looked up in one projection)", with_ctes(_KERNEL_SQL, """
SELECT row_id, exp(l1 - greatest(l1, l0)) / (exp(l1 - greatest(l1, l0)) + exp(l0 - greatest(l1, l0))) AS prob FROM w"""))
def kernel_nb(spark, sf_dir):
    lab = sp.with_id(_labelled(spark, sf_dir), tr.TRACE_KEY).withColumn("label", F.col("Malicious").cast("double")).where("label IS NOT NULL")
    lab = sp.split_fraction(lab, "row_id", 0.7).select("row_id", "label", "part", *_KERNEL_FEATS)
    model = kn.fit(lab.where(F.col("part") == "train"), _KERNEL_FEATS)
    return kn.score(lab.where(F.col("part") == "test"), model, _KERNEL_FEATS).select("row_id", "prob")


# --- lasso from moments, all 33 features ----------------------------------

#: every numeric column of the trace layout; the skewed ones are log-transformed for linear scores
ALL_FEATURES = [c for c in TRACE_COLUMNS_A[5:]]
_LOG = set(_SK)


def _loo_rows(spark, sf_dir):
    """Labelled traces with the linear models' preparation, fold and band: one row a trace."""
    lab = ds.log1p_features(sp.with_id(_labelled(spark, sf_dir), tr.TRACE_KEY))
    lab = lab.withColumn("label", F.col("Malicious").cast("double")).where("label IS NOT NULL")
    lab = sp.cv_folds(lab, "row_id", 10).select("row_id", "Family", "label", "fold", *[F.col(c).cast("double").alias(c) for c in ALL_FEATURES])
    rows, sizes = ls.with_bands(lab, "row_id", MALWARE_FAMILIES)
    return rows.checkpoint(eager=True), sizes


@query("loo_moments", "L6 M3 (training rows of each left-out family: count, mean, deviation, correlation with the label)", with_ctes(V.LABELLED + f""",
lab AS (SELECT {_RID} AS row_id, Family, CAST(Malicious AS DOUBLE) AS label, """ + ", ".join(
    (f"ln(1 + CAST({c} AS DOUBLE))" if c in _LOG else f"CAST({c} AS DOUBLE)") + f" AS {c}" for c in ALL_FEATURES) + f""" FROM labelled),
nr AS (SELECT row_id, row_number() OVER (ORDER BY {_MD5}) AS nrank FROM lab WHERE Family = 'Normal'),
folds AS (SELECT f AS family, (SELECT count(*) FROM lab WHERE Family = f) AS nf FROM (SELECT unnest([{_FAMS}]) AS f)),
tr AS (SELECT f.family, l.* EXCLUDE (Family) FROM lab l LEFT JOIN nr USING (row_id) JOIN folds f
       ON l.Family <> f.family AND (l.Family <> 'Normal' OR nr.nrank > f.nf))""", " UNION ALL ".join(f"""
SELECT family, '{c}' AS feature, count(*) AS n, avg({c}) AS mean, stddev_pop({c}) AS sd,
  CASE WHEN stddev_pop({c}) > 0 THEN covar_pop({c}, label) / stddev_pop({c}) / stddev_pop(label) END AS label_corr FROM tr GROUP BY family""" for c in ALL_FEATURES)))
def loo_moments(spark, sf_dir):
    rows, sizes = _loo_rows(spark, sf_dir)
    names = sorted({*MALWARE_FAMILIES, "Normal"})
    columns = [*ALL_FEATURES, "label"]
    rows = ds.complete_cases(rows, columns)
    about = [v or 0.0 for v in rows.agg(*[F.avg(c) for c in columns]).first()]
    cells = ls.cell_moments(rows, ls.cell_number(names, MALWARE_FAMILIES, 10), columns, about)
    out = []
    for family, by_fold in ls.training_moments(cells, names, MALWARE_FAMILIES, sizes, 10).items():
        n, mean, scale, _, covariance = ls.standardised(sum(by_fold))
        for c, m, a, s, v in zip(ALL_FEATURES, mean, about, scale, covariance):
            out.append((family, c, int(n), float(m + a), float(s), float(v / scale[-1]) if s > 0 else None))
    return spark.createDataFrame(out, "family string, feature string, n bigint, mean double, sd double, label_corr double")


def _loo_lasso(spark, sf_dir):
    rows, sizes = _loo_rows(spark, sf_dir)
    fits = ls.leave_family_out_fits(rows, ALL_FEATURES, MALWARE_FAMILIES, sizes)
    return rows, sizes, fits


@query("loo_lasso", "L6 L16 E7 (lasso without each family: 100 lambdas x 10 folds, one-standard-error rule, all 33 features)")
def loo_lasso(spark, sf_dir):
    rows, sizes, fits = _loo_lasso(spark, sf_dir)
    metrics = ev.metric_table(ls.score_left_out(rows, fits, ALL_FEATURES, sizes), ["family"], label="obs", score="prob", pred="pred")
    chosen = spark.createDataFrame([(f, t.n, t.chosen, t.best, sum(s != 0 for s in t.slopes)) for f, t in fits.items()],
                                   "family string, n_train bigint, lambda_1se double, lambda_min double, n_terms int")
    return chosen.join(metrics, "family")


@query("loo_lasso_path", "L6 (cross-validated error and its standard error at each lambda, for each left-out family)")
def loo_lasso_path(spark, sf_dir):
    _, _, fits = _loo_lasso(spark, sf_dir)
    rows = [(f, i, *r) for f, t in fits.items() for i, r in enumerate(t.path)]
    return spark.createDataFrame(rows, "family string, step int, lambda double, cv_mse double, cv_se double, n_terms int")


# --- streams --------------------------------------------------------------

from flowtrace.streaming import running as rn  # noqa: E402
from flowtrace.streaming import traces as st  # noqa: E402


@query("stream_traces", "T1", with_ctes(V.TRACES, f"""
SELECT {_TK}, startTime, flowct, mean_dest_bytes, mean_dest_pkts, mean_duration, mean_src_bytes, mean_src_pkts,
       mean_intvl, {_FLAGS_SQL} FROM traces"""))
def stream_traces(spark, sf_dir):
    out, ck = csvio.scratch_path(spark, "stream_traces"), csvio.scratch_path(spark, "stream_traces_ck")
    # update mode: each trigger writes only the keys it changed; readers keep each key's latest row
    st.run_available(st.stream_trace_aggregates(st.flows_stream(spark, sf_dir, max_files=1)), out, ck,
                     mode="update")
    return st.read_latest(spark, out, tr.TRACE_KEY)


@query("stream_deviation", "T2", with_ctes(V.TRACES, f"""
SELECT {_TK}, flowct, stdev_dest_bytes, stdev_dest_pkts, stdev_duration, stdev_src_bytes, stdev_src_pkts,
       mean_intvl, stdev_intvl, CAST(0 AS BIGINT) AS late_rows FROM traces"""))
def stream_deviation(spark, sf_dir):
    out, rows, ck = (csvio.scratch_path(spark, n) for n in ("stream_dev", "stream_dev_rows", "stream_dev_ck"))
    st.run_deviation(st.flows_stream(spark, sf_dir), out, rows, ck)
    return st.read_latest(spark, out, tr.TRACE_KEY)


@query("stream_running_stats", "T2 (event-time order, state bounded by the watermark)", with_ctes(V.TRACES, f"""
SELECT {_TK}, startTime, flowct, {", ".join(f"mean_{v}, stdev_{v}" for v in tr.TRACE_VALUES)}, mean_intvl, stdev_intvl, CAST(0 AS BIGINT) AS held_rows FROM traces"""))
def stream_running_stats(spark, sf_dir):
    flows = st.stream_inputs(fx.flows(spark, sf_dir)).select(*tr.TRACE_KEY, "ts", "uid", *tr.TRACE_VALUES)
    src, out, ck = (csvio.scratch_path(spark, n) for n in ("running_src", "running_out", "running_ck"))
    delay = rn.write_in_files(flows, src, 8)
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    st.run_available(rn.running_stats(stream, f"{math.ceil(delay)} seconds"), out, ck, mode="update")
    return st.read_latest(spark, out, tr.TRACE_KEY)


@query("stream_log_dir", "T3 S1", with_ctes(V.FLOWS, f"SELECT {_KEPT_COLS} FROM flows"))
def stream_log_dir(spark, sf_dir):
    logs, out, ck = (csvio.scratch_path(spark, n) for n in ("stream_logs", "stream_logs_out", "stream_logs_ck"))
    zeek.write_log(fx.flows(spark, sf_dir).repartition(4), logs)
    st.run_available(st.stream_conn_logs(spark, logs, max_files=2), out, ck, mode="append")
    return spark.read.parquet(out)
