"""DuckDB text of the derived views, used by the oracle queries.

Each view mirrors a function in :mod:`flowtrace.sources.fixture`; the oracle
queries are built from these so that Spark and DuckDB read the same tables.
"""

from __future__ import annotations

from flowtrace.schema import FLAG_ORDER, MALWARE_FAMILIES, flag_column

FLOWS = """
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         floor(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1000000.0) AS s
  FROM events),
flows AS (
  SELECT CAST(s AS DOUBLE) AS ts,
         'C' || CAST(event_id AS VARCHAR) AS uid,
         '10.0.' || CAST(CAST(floor(user_id / 256) AS BIGINT) AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS id_orig_h,
         CAST(1024 + event_id % 50000 AS INTEGER) AS id_orig_p,
         '192.0.2.' || CAST(k % 2 AS VARCHAR) AS id_resp_h,
         CAST(CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'signup' THEN 53
                              WHEN 'purchase' THEN 8080 ELSE 0 END AS INTEGER) AS id_resp_p,
         CASE event_type WHEN 'signup' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'tcp' END AS proto,
         CASE event_type WHEN 'signup' THEN 'dns' WHEN 'error' THEN NULL ELSE 'http' END AS service,
         CASE WHEN k % 10 = 0 THEN NULL ELSE round(value * 16) / 16 END AS duration,
         CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(round(value * 10) AS BIGINT) END AS orig_bytes,
         CAST(k * 37 AS BIGINT) AS resp_bytes,
         'SF' AS conn_state, TRUE AS local_orig, FALSE AS local_resp, CAST(0 AS BIGINT) AS missed_bytes,
         CASE k % 6 WHEN 0 THEN 'ShADadfF' WHEN 1 THEN 'Dd' WHEN 2 THEN 'D' WHEN 3 THEN NULL
                    WHEN 4 THEN 'ShADadR' ELSE 'SrI' END AS history,
         CAST(1 + k % 9 AS BIGINT) AS orig_pkts,
         CAST(coalesce(CAST(round(value * 10) AS BIGINT), 0) + (k % 9 + 1) * 20 AS BIGINT) AS orig_ip_bytes,
         CAST(k % 7 AS BIGINT) AS resp_pkts,
         CAST(k * 37 + (k % 7) * 20 AS BIGINT) AS resp_ip_bytes,
         user_id
  FROM ev)"""

_FLAG_SQL = ",\n         ".join(
    f"coalesce(CAST(instr(history, '{L}') > 0 AS INTEGER), 0) AS {flag_column(L)}" for L in FLAG_ORDER)

# reference view of the flows: trace key names, unset values as 0, flags
TIN = FLOWS + f""",
tin AS (
  SELECT id_orig_h AS srcIP, id_resp_h AS destIP, id_resp_p AS destPt, proto AS protocol, ts, uid,
         CAST(coalesce(resp_bytes, 0) AS DOUBLE) AS dest_bytes,
         CAST(coalesce(resp_pkts, 0) AS DOUBLE) AS dest_pkts,
         CAST(coalesce(duration, 0) AS DOUBLE) AS duration,
         CAST(coalesce(orig_bytes, 0) AS DOUBLE) AS src_bytes,
         CAST(coalesce(orig_pkts, 0) AS DOUBLE) AS src_pkts,
         {_FLAG_SQL}
  FROM flows)"""

_VALS = ["dest_bytes", "dest_pkts", "duration", "src_bytes", "src_pkts"]
_KEY = "srcIP, destIP, destPt, protocol"
_W = f"PARTITION BY {_KEY} ORDER BY ts, uid"

TRACES = TIN + f""",
staged AS (
  SELECT {_KEY}, ts, {", ".join(_VALS)}, {", ".join(flag_column(L) for L in FLAG_ORDER)},
         {", ".join(f"abs({v} - avg({v}) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS dev_{v}" for v in _VALS)},
         ts - lag(ts) OVER ({_W}) AS gap
  FROM tin),
traces AS (
  SELECT {_KEY}, min(ts) AS startTime, count(*) AS flowct,
         avg(dest_bytes) AS mean_dest_bytes, avg(dev_dest_bytes) AS stdev_dest_bytes,
         avg(dest_pkts) AS mean_dest_pkts, avg(dev_dest_pkts) AS stdev_dest_pkts,
         avg(duration) AS mean_duration, avg(dev_duration) AS stdev_duration,
         coalesce(avg(gap), 0) AS mean_intvl, coalesce(stddev_pop(gap), 0) AS stdev_intvl,
         avg(src_bytes) AS mean_src_bytes, avg(dev_src_bytes) AS stdev_src_bytes,
         avg(src_pkts) AS mean_src_pkts, avg(dev_src_pkts) AS stdev_src_pkts,
         {", ".join(f"CAST(sum({flag_column(L)}) AS BIGINT) AS {flag_column(L)}" for L in FLAG_ORDER)}
  FROM staged GROUP BY {_KEY})"""

_FAM_CASE = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(MALWARE_FAMILIES))

# labelled traces: one trace table per capture (user_id % 16), family attached
CAPTURES = f"""
captures AS (
  SELECT CAST(i AS INTEGER) AS capture, 'traces_' || CAST(i AS VARCHAR) || '_1.log.csv' AS File,
         CASE i {_FAM_CASE} ELSE 'Normal' END AS Family,
         CASE WHEN i < 8 THEN 'malicious' ELSE 'normal' END AS Type
  FROM range(16) t(i))"""

# trace table with capture label (capture = last address octet % 16)
LABELLED = TRACES + "," + CAPTURES + """,
labelled AS (
  SELECT t.*, c.File, c.Family, c.Type, CASE WHEN c.Family <> 'Normal' THEN 1 ELSE 0 END AS Malicious
  FROM traces t JOIN captures c
    ON c.capture = CAST(split_part(t.srcIP, '.', 4) AS INTEGER) % 16)"""
