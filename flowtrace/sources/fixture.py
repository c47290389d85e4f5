"""Stand-in inputs derived from the driver tables.

The driver ships TPC-H-like tables plus ``events``; these functions derive
connection flows, HTTP records, capture labels and scored tables from them,
so every query's work grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.schema import MALWARE_FAMILIES, NORMAL_FAMILY

EPOCH = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows_from_events(events: DataFrame) -> DataFrame:
    """Typed connection flows (conn log columns, ``.`` as ``_``) from ``events``.

    Times are whole seconds, durations sixteenths, byte counts integers, so
    Spark and SQL engines agree to the last printed digit.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    secs = F.floor(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, ts)") / F.lit(1000000.0))
    e = events.select("event_id", "user_id", "event_type", "value", k.alias("k"), secs.alias("s"))
    et = F.col("event_type")
    k = F.col("k")
    unset = (k % 10) == 0
    return e.select(
        F.col("s").cast("double").alias("ts"),
        F.concat(F.lit("C"), F.col("event_id").cast("string")).alias("uid"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."),
                 (F.col("user_id") % 256).cast("string")).alias("id_orig_h"),
        (F.lit(1024) + F.col("event_id") % 50000).cast("int").alias("id_orig_p"),
        F.concat(F.lit("192.0.2."), (k % 2).cast("string")).alias("id_resp_h"),
        F.when(et == "click", 80).when(et == "view", 443).when(et == "signup", 53)
         .when(et == "purchase", 8080).otherwise(0).cast("int").alias("id_resp_p"),
        F.when(et == "signup", "udp").when(et == "error", "icmp").otherwise("tcp").alias("proto"),
        F.when(et == "signup", "dns").when(et == "error", F.lit(None)).otherwise("http").alias("service"),
        F.when(unset, F.lit(None)).otherwise(F.round(F.col("value") * 16) / 16).alias("duration"),
        F.when(unset, F.lit(None)).otherwise(F.round(F.col("value") * 10).cast("bigint")).alias("orig_bytes"),
        (k * 37).cast("bigint").alias("resp_bytes"),
        F.lit("SF").alias("conn_state"),
        F.lit(True).alias("local_orig"),
        F.lit(False).alias("local_resp"),
        F.lit(0).cast("bigint").alias("missed_bytes"),
        F.element_at(F.array(*[F.lit(h) for h in ["ShADadfF", "Dd", "D", None, "ShADadR", "SrI"]]),
                     (k % 6 + 1).cast("int")).alias("history"),
        (F.lit(1) + k % 9).cast("bigint").alias("orig_pkts"),
        (F.coalesce(F.round(F.col("value") * 10).cast("bigint"), F.lit(0)) + (k % 9 + 1) * 20)
        .cast("bigint").alias("orig_ip_bytes"),
        (k % 7).cast("bigint").alias("resp_pkts"),
        (k * 37 + (k % 7) * 20).cast("bigint").alias("resp_ip_bytes"),
        F.array().cast("array<string>").alias("tunnel_parents"),
        F.col("user_id"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows_from_events(read_table(spark, sf_dir, "events"))


def capture_of(user_id) -> F.Column:
    return (F.col(user_id) % 16).cast("int")


def capture_file(capture) -> F.Column:
    return F.concat(F.lit("traces_"), F.col(capture).cast("string"), F.lit("_1.log.csv"))


def capture_labels(spark: SparkSession) -> DataFrame:
    """Capture label table: file index, file name, family, type (16 rows)."""
    rows = [(i, f"traces_{i}_1.log.csv", MALWARE_FAMILIES[i] if i < 8 else NORMAL_FAMILY) for i in range(16)]
    df = spark.createDataFrame(rows, "capture int, File string, Family string")
    return df.withColumn("Type", F.when(F.col("Family") == NORMAL_FAMILY, "normal").otherwise("malicious"))


def http_records(flow_df: DataFrame) -> DataFrame:
    """HTTP log records from the tcp flows (18 fields, log order)."""
    k = (F.col("resp_bytes") / 37).cast("int")
    t = flow_df.where(F.col("proto") == "tcp")
    return t.select(
        "ts", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p",
        F.col("id_resp_h").alias("host"),
        F.col("orig_bytes").alias("request_body_len"),
        F.lit(None).cast("string").alias("proxied"),
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("method"),
        F.lit(None).cast("string").alias("orig_filenames"),
        F.lit(None).cast("string").alias("resp_filenames"),
        F.col("resp_bytes").alias("response_body_len"),
        F.lit(None).cast("bigint").alias("status_code"),
        F.lit(None).cast("string").alias("status_msg"),
        F.lit(None).cast("string").alias("tags"),
        F.lit(None).cast("string").alias("user_agent"),
        F.concat(F.lit("/a,b?k="), k.cast("string")).alias("uri"),
        F.lit(None).cast("string").alias("version"),
    )


def dns_names(flow_df: DataFrame) -> DataFrame:
    """Host name table: one name per source address that ends in a multiple of 3.

    Derived from the flows' own addresses so it grows with the data.
    """
    hosts = flow_df.select("id_orig_h").distinct()
    x = F.split("id_orig_h", r"\.").getItem(3).cast("int")
    return hosts.where(x % 3 == 0).select(
        F.col("id_orig_h").alias("host"),
        F.concat(F.lit("host-"), F.replace(F.col("id_orig_h"), F.lit("."), F.lit("-")), F.lit(".example.net")).alias("name"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table that needs no model: label = toxic, score = n_chars."""
    labels = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(
        "doc_id", F.col("toxic").cast("int").alias("label"), F.col("n_chars").cast("double").alias("score"))
