"""Trace features on streams (Structured Streaming).

* :func:`stream_trace_aggregates` - count, start, means, flags and mean gap
  per key as flows arrive: a streaming ``groupBy``; the mean gap is
  (last - first) / (n - 1), so no list of times is kept.  With ``window``
  and ``watermark`` the state is per event-time window and is dropped once
  the watermark passes it (finite state); without them the state holds one
  row per key (a global table, as in batch).
* :func:`run_deviation` - the order-dependent statistics (running mean absolute
  deviation, gap mean/std) for rows of any age: each trigger's rows are appended
  to a written table, and the keys that they touch are computed again from all
  their rows by the range-sliced windows, so rows may come in any order and a hot
  key is cut into slices.  Where rows are late by a bounded time only,
  :mod:`flowtrace.streaming.running` needs neither that table nor a second read.
* :func:`stream_conn_logs` - log files arriving in a folder, parsed as in
  batch (``maxFilesPerTrigger`` bounds each trigger).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.functions.exprs import history_flags, unset_to_zero
from flowtrace.operators.traces import VALUE_SOURCES, conn_traces
from flowtrace.schema import CONN_FIELDS, CONN_KEPT, FLAG_COLUMNS, TRACE_KEY, TRACE_VALUES
from flowtrace.sources import zeek
from flowtrace.sources.fixture import flows_from_events


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """``events`` as a file stream (the glob names exactly that one file)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(f"{sf_dir}/events.parque[t]")


def stream_inputs(flows: DataFrame) -> DataFrame:
    return flows.select(
        F.col("id_orig_h").alias("srcIP"), F.col("id_resp_h").alias("destIP"),
        F.col("id_resp_p").alias("destPt"), F.col("proto").alias("protocol"), "ts", "uid",
        *[unset_to_zero(src, "double").alias(v) for v, src in VALUE_SOURCES.items()],
        *history_flags("history"))


def stream_trace_aggregates(flows: DataFrame, window: str | None = None, watermark: str | None = None) -> DataFrame:
    v = stream_inputs(flows)
    keys = list(TRACE_KEY)
    if window:
        v = v.withColumn("ts_time", F.timestamp_seconds("ts"))
        if watermark:
            v = v.withWatermark("ts_time", watermark)
        keys = [F.window("ts_time", window).alias("window")] + keys
    n = F.count(F.lit(1))
    return v.groupBy(*keys).agg(
        F.min("ts").alias("startTime"), n.alias("flowct"),
        *[F.avg(x).alias("mean_" + x) for x in TRACE_VALUES],
        F.coalesce(F.try_divide(F.max("ts") - F.min("ts"), n - 1), F.lit(0.0)).alias("mean_intvl"),
        *[F.sum(c).alias(c) for c in FLAG_COLUMNS])


# --- running a stream to completion ------------------------------------------

def run_available(stream: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available, then stop.

    ``append``: a Parquet file sink.  ``complete``/``update``: each trigger's
    rows are appended with the batch id (``foreachBatch``); readers keep the
    last row per key (:func:`read_latest`).
    """
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").outputMode("append").start(out_path)
    else:
        def sink(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_path)
        q = w.outputMode(mode).foreachBatch(sink).start()
    q.awaitTermination()


def run_deviation(flows: DataFrame, out_path: str, rows_path: str, checkpoint: str) -> None:
    """Running deviations of a stream of flows: process everything available, then stop.

    ``rows_path`` holds all rows that came, a folder for each trigger, and
    ``out_path`` the keys that each trigger touched (:func:`read_latest`).  A
    trigger that is run again replaces its folders.
    """
    key = ["id_orig_h", "id_resp_h", "id_resp_p", "proto"]

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{rows_path}/batch_id={batch_id}")
        rows = spark.read.schema(batch.schema).parquet(rows_path)
        new = spark.read.schema(batch.schema).parquet(f"{rows_path}/batch_id={batch_id}")
        touched = new.select(*[F.col(k).alias("t_" + k) for k in key]).distinct()
        same = [F.col(k).eqNullSafe(F.col("t_" + k)) for k in key]
        made = conn_traces(rows.join(touched, same, "left_semi"))
        made.select(*TRACE_KEY, F.col("flowct").cast("long").alias("flowct"), *["stdev_" + x for x in TRACE_VALUES],
                    "mean_intvl", "stdev_intvl", F.lit(0).cast("long").alias("late_rows")).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")

    flows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def read_latest(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """Last emitted row per key from an update/complete stream's output; NULL key fields are equal."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*key, "batch_id")]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("__last"))
    return last.select(*key, "__last.*")


def stream_conn_logs(spark: SparkSession, log_dir: str, max_files: int = 2,
                     fields: Sequence[tuple[str, str]] = CONN_FIELDS, keep: Sequence[str] = CONN_KEPT) -> DataFrame:
    """Connection logs arriving in ``log_dir``, parsed with the given header."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(log_dir)
    return zeek.parse_lines(lines, [n for n, _ in fields], [t for _, t in fields], keep)


def flows_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    return flows_from_events(events_stream(spark, sf_dir, max_files))
