"""The hot-key-safe forms equal the plain window forms."""

import pytest
from pyspark.sql import functions as F

from flowtrace.operators import flows as fl
from flowtrace.operators import traces as tr
from flowtrace.sources import fixture as fx
from tests.conftest import SF001, SF01


def rows(df, digits=6):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_segmented_equals_window(spark, parts):
    f = fx.flows(spark, SF01)
    a = tr.conn_traces(f, method="window")
    b = tr.conn_traces(f, method="segmented", num_partitions=parts)
    assert rows(a) == rows(b)


def hot_flows(spark):
    """sf0.001 flows plus one key holding about a third of all rows."""
    f = fx.flows(spark, SF001)
    hot = (f.where(F.col("proto") == "tcp")
           .withColumn("id_orig_h", F.lit("10.9.9.9")).withColumn("id_resp_h", F.lit("192.0.2.0"))
           .withColumn("id_resp_p", F.lit(80)).withColumn("uid", F.concat(F.lit("H"), F.col("uid"))))
    return f.unionByName(hot)


def test_hot_key_is_split_and_exact(spark):
    f = hot_flows(spark)
    slices = tr.sorted_slices(f, num_partitions=16)
    hot_slices = slices.where(F.col("srcIP") == "10.9.9.9").select("pid").distinct().count()
    assert hot_slices >= 4  # the hot key runs in many tasks
    assert rows(tr.conn_traces(f, method="window")) == rows(tr.conn_traces(f, num_partitions=16))


def test_ordered_rows_equal_window_functions(spark):
    from pyspark.sql import Window
    f = hot_flows(spark)
    w = Window.partitionBy(*fl.CONN_KEY).orderBy("ts", "uid")
    ref = f.select("uid", (F.col("ts") - F.lag("ts").over(w)).alias("gap_prev"),
                   (F.lead("ts").over(w) - F.col("ts")).alias("gap_next"),
                   F.avg(F.coalesce("resp_bytes", F.lit(0))).over(
                       w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("rm"))
    got = fl.ordered_rows(fl.reference_values(f), fl.CONN_KEY, ["resp_bytes"], num_partitions=13)
    got = got.select("uid", "gap_prev", "gap_next", F.col("run_mean_resp_bytes").alias("rm"))
    assert rows(ref) == rows(got)


def test_trace_table_ignores_row_order_and_partitioning(spark):
    f = fx.flows(spark, SF001)
    a = tr.conn_traces(f, num_partitions=5)
    b = tr.conn_traces(f.repartition(11).orderBy(F.rand(3)), num_partitions=9)
    assert rows(a) == rows(b)
    assert a.agg(F.sum("flowct")).first()[0] == f.count()


def test_trace_ids_dense_and_ordered(spark):
    f = fx.flows(spark, SF001)
    ids = fl.trace_ids(f, num_partitions=6).orderBy("trace_id").collect()
    assert [r["trace_id"] for r in ids] == list(range(len(ids)))


@pytest.mark.parametrize("batch", [3, 7])
def test_runs_crossing_arrow_batches(spark, batch):
    """Keys whose runs span many Arrow batches inside one slice."""
    from pyspark.sql import Window
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        f = hot_flows(spark)
        assert rows(tr.conn_traces(f, method="window")) == rows(tr.conn_traces(f, num_partitions=5))
        w = Window.partitionBy(*fl.CONN_KEY).orderBy("ts", "uid")
        ref = f.select("uid", (F.col("ts") - F.lag("ts").over(w)).alias("gap_prev"),
                       (F.lead("ts").over(w) - F.col("ts")).alias("gap_next"),
                       F.avg(F.coalesce("orig_pkts", F.lit(0))).over(
                           w.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("rm"))
        got = fl.ordered_rows(fl.reference_values(f), fl.CONN_KEY, ["orig_pkts"], num_partitions=5)
        got = got.select("uid", "gap_prev", "gap_next", F.col("run_mean_orig_pkts").alias("rm"))
        assert rows(ref) == rows(got)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_unset_key_fields_are_keys_like_any_other(spark):
    """Flows without a responder port: their runs, gaps and running values, also over slice edges."""
    from pyspark.sql import Window
    five = spark.createDataFrame([(float(i), f"u{i}", "10.0.0.1", "192.0.2.1", None, "icmp", 4 * i) for i in range(5)],
                                 "ts double, uid string, id_orig_h string, id_resp_h string, id_resp_p int, proto string, resp_bytes bigint")
    got = fl.ordered_rows(five, fl.CONN_KEY, ["resp_bytes"], num_partitions=3).orderBy("ts").collect()
    assert [r.gap_next for r in got] == [1.0] * 4 + [None] and [r.gap_prev for r in got] == [None] + [1.0] * 4
    assert [r.pos for r in got] == [1, 2, 3, 4, 5] and [r.run_mean_resp_bytes for r in got] == [0.0, 2.0, 4.0, 6.0, 8.0]
    f = hot_flows(spark).withColumn("id_resp_p", F.when(F.col("proto") != "icmp", F.col("id_resp_p"))).withColumn(
        "id_orig_h", F.when(F.col("id_orig_h") != "10.0.0.3", F.col("id_orig_h")))
    w = Window.partitionBy(*fl.CONN_KEY).orderBy("ts", "uid")
    ref = f.select("uid", (F.col("ts") - F.lag("ts").over(w)).alias("a"), (F.lead("ts").over(w) - F.col("ts")).alias("b"))
    for parts in (1, 11):
        assert rows(fl.gaps(f, parts).select("uid", F.col("gap_prev").alias("a"), F.col("gap_next").alias("b"))) == rows(ref)
        assert rows(tr.conn_traces(f, num_partitions=parts)) == rows(tr.conn_traces(f, method="window"))


def test_slices_of_a_checkpoint_follow_its_rows_not_the_estimate_of_its_joins(spark):
    from flowtrace.operators.ordered import slice_count
    one = spark.range(3000).selectExpr("id", "id % 7 AS v")
    joined = one.join(one.select("id"), "id").join(one.select("id"), "id").join(one.select("id"), "id").checkpoint(eager=True)
    base = slice_count(one)
    assert slice_count(joined.select("id", "v")) == base
    assert slice_count(joined.groupBy("v").count()) == base
    spark.conf.set("flowtrace.slice.bytes", "1000")
    try:
        assert slice_count(joined.select("id", "v")) == 3000 * 40 // 1000
    finally:
        spark.conf.unset("flowtrace.slice.bytes")
