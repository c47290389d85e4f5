import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtrace.operators import models as ml
from flowtrace.operators import profile as pf
from flowtrace.operators import stats
from flowtrace.streaming import traces as st


def flow_rows(rows):
    """(uid, ts, resp_bytes) rows of one key as typed flows."""
    return [dict(ts=float(ts), uid=uid, id_orig_h="10.0.0.1", id_orig_p=1, id_resp_h="192.0.2.0", id_resp_p=80,
                 proto="tcp", service=None, duration=1.0, orig_bytes=10, resp_bytes=rb, conn_state="SF",
                 local_orig=True, local_resp=False, missed_bytes=0, history="ShAD", orig_pkts=1, orig_ip_bytes=0,
                 resp_pkts=1, resp_ip_bytes=0, tunnel_parents=[]) for uid, ts, rb in rows]


def test_box_cox_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.lognormal(1.0, 0.6, 300)
    df = spark.createDataFrame([(float(v), float(v) - 1.0) for v in x], "a double, b double")
    got = {r["field"]: r["bc_lambda"] for r in ml.box_cox_lambdas(df, ["a", "b"]).collect()}
    assert "b" not in got or (x - 1.0).min() > 0  # b has values <= 0: not transformable

    def ll(lam):
        y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * np.log(x).sum()

    best = max(ml.LAMBDA_GRID, key=ll)
    assert got["a"] == pytest.approx(best)


def test_gaussian_nb_matches_numpy(spark):
    rng = np.random.default_rng(7)
    n = 200
    y = rng.integers(0, 2, n)
    X = rng.normal(0, 1, (n, 2)) + y[:, None] * 1.5
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, (b, c) in zip(y, X)], "label int, f1 double, f2 double")
    model = ml.gaussian_nb_fit(df, ["f1", "f2"])
    got = np.array([r["prob"] for r in ml.gaussian_nb_score(df, model, ["f1", "f2"]).orderBy(
        F.monotonically_increasing_id()).collect()])
    lp = []
    for c in (0, 1):
        Xc = X[y == c]
        prior = len(Xc) / n
        mu, var = Xc.mean(0), Xc.var(0) + 1e-9
        lp.append(np.log(prior) - 0.5 * np.log(2 * np.pi * var).sum() - ((X - mu) ** 2 / (2 * var)).sum(1))
    want = 1 / (1 + np.exp(lp[0] - lp[1]))
    assert np.allclose(np.sort(got), np.sort(want), atol=1e-9)


def test_contingency_keeps_zero_cells(spark):
    df = spark.createDataFrame([("x", "tcp"), ("x", "udp"), ("y", "tcp")], "a string, b string")
    got = {(r["a"], r["b"]): r["n"] for r in pf.contingency(df, "a", "b").collect()}
    assert got == {("x", "tcp"): 1, ("x", "udp"): 1, ("y", "tcp"): 1, ("y", "udp"): 0}


def test_grouped_quantiles(spark):
    df = spark.range(0, 100).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    got = {(r["g"], r["prob"]): r["q"] for r in stats.exact_quantiles(df, "v", [0.5, 0.9], ["g"], 4).collect()}
    for g in (0, 1):
        vals = np.arange(g, 100, 2, dtype=float)
        assert got[(g, 0.5)] == pytest.approx(np.quantile(vals, 0.5))
        assert got[(g, 0.9)] == pytest.approx(np.quantile(vals, 0.9))


def test_lasso_one_se_rule(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(0, 1, (300, 3))
    y = (X[:, 0] + 0.2 * rng.normal(0, 1, 300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t), i % 3) for i, ((a, b, c), t) in
                                enumerate(zip(X, y))], "a double, b double, c double, label double, fold int")
    lam, path = ml.lasso_path(df, ["a", "b", "c"], lambdas=[0.3, 0.1, 0.03, 0.01])
    best = min(path, key=lambda r: r[1])
    assert lam >= best[0]
    chosen = [r for r in path if r[0] == lam][0]
    assert chosen[1] <= best[1] + best[2]


def test_forest_repeatable_and_learns_planted_rule(spark):
    from flowtrace.operators import evaluate as ev
    rng = np.random.default_rng(11)
    X = rng.normal(0, 1, (400, 4))
    y = ((X[:, 0] > 0) & (X[:, 1] > -0.5)).astype(float)
    df = spark.createDataFrame([(str(i), float(t), *map(float, x)) for i, (t, x) in enumerate(zip(y, X))],
                               "row_id string, label double, a double, b double, c double, d double")
    train, test = df.where("CAST(row_id AS INT) % 4 <> 0"), df.where("CAST(row_id AS INT) % 4 = 0")
    s1, _ = ml.random_forest(train, test, ["a", "b", "c", "d"], num_trees=20, seed=3)
    s2, _ = ml.random_forest(train, test, ["a", "b", "c", "d"], num_trees=20, seed=3)
    p1 = sorted((r["row_id"], r["prob"]) for r in s1.collect())
    assert p1 == sorted((r["row_id"], r["prob"]) for r in s2.collect())
    auc = ev.auc(s1.withColumnRenamed("obs", "label").withColumnRenamed("prob", "score")).first()["auc"]
    assert auc > 0.9


def test_forests_keep_node_ids_and_give_the_same_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier
    rng = np.random.default_rng(12)
    X = rng.normal(0, 1, (300, 4))
    df = spark.createDataFrame([(str(i), float(x[0] * x[1] > x[2]), i % 3, *map(float, x)) for i, x in enumerate(X)],
                               "row_id string, label double, fold int, a double, b double, c double, d double")
    params = dict(numTrees=5, maxDepth=12, featureSubsetStrategy="2", seed=11)
    data = ml.assemble(df, ["a", "b", "c", "d"])
    plain = RandomForestClassifier(featuresCol="features", labelCol="label", **params).fit(data)
    kept = ml.forest(**params).fit(data)
    assert kept.getCacheNodeIds() and kept.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
    _, tuned = ml.random_forest(df, df, ["a", "b", "c", "d"], num_trees=2, fold_col="fold", subsets=["2", "4"])
    assert tuned.getCacheNodeIds()


def test_windowed_stream_emits_closed_windows(spark, scratch):
    """Event-time windows with a watermark: finite state, append output."""
    from flowtrace.schema import conn_flow_schema
    schema = conn_flow_schema()
    src = scratch("win_src")
    early = spark.createDataFrame(flow_rows([("C1", 10, 100), ("C2", 20, 300)]), schema)
    late_batch = spark.createDataFrame(flow_rows([("C3", 7200, 50), ("C4", 7300, 70)]), schema)
    early.coalesce(1).write.parquet(src + "/a")
    late_batch.coalesce(1).write.parquet(src + "/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    agg = st.stream_trace_aggregates(stream, window="1 hour", watermark="10 minutes")
    out, ck = scratch("win_out"), scratch("win_ck")
    st.run_available(agg, out, ck, mode="append")
    got = spark.read.parquet(out).collect()
    # the first hour closed once the watermark passed it; the last window stays open in state
    assert len(got) == 1 and got[0]["flowct"] == 2 and got[0]["mean_intvl"] == pytest.approx(10.0)


def test_histogram_nb_learns_bimodal_class(spark):
    from flowtrace.operators import evaluate as ev
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 600)
    x = np.where(y == 1, rng.choice([-2.0, 2.0], 600) + rng.normal(0, 0.3, 600), rng.normal(0, 0.3, 600))
    df = spark.createDataFrame([(str(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, x))],
                               "row_id string, label int, f double")
    tr, te = df.where("CAST(row_id AS INT) % 3 <> 0"), df.where("CAST(row_id AS INT) % 3 = 0")
    k = ml.histogram_nb_grouped(tr, te, ["f"], bins=16)
    assert k.count() == te.count()
    auc = ev.auc(k.withColumnRenamed("obs", "label").withColumnRenamed("prob", "score")).first()["auc"]
    assert auc > 0.95


def test_aggregate_stream_over_triggers_equals_batch(spark, scratch):
    from flowtrace.schema import conn_flow_schema
    schema = conn_flow_schema()
    src = scratch("agg_src")
    a = spark.createDataFrame(flow_rows([("C1", 10, 100), ("C2", 14, 300)]), schema)
    b = spark.createDataFrame(flow_rows([("C3", 30, 50)]), schema)
    a.coalesce(1).write.parquet(src + "/a")
    b.coalesce(1).write.parquet(src + "/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out, ck = scratch("agg_out"), scratch("agg_ck")
    st.run_available(st.stream_trace_aggregates(stream), out, ck, mode="update")
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2  # two triggers
    r = st.read_latest(spark, out, ["srcIP", "destIP", "destPt", "protocol"]).first()
    assert r["flowct"] == 3 and r["startTime"] == 10.0
    assert r["mean_dest_bytes"] == pytest.approx(150.0) and r["mean_intvl"] == pytest.approx(10.0)


def test_deviation_counts_rows_out_of_order_over_triggers(spark, scratch):
    """Rows older than what their key has seen count like others: as in batch, whatever the triggers."""
    from flowtrace.operators.traces import conn_traces
    from flowtrace.schema import conn_flow_schema
    schema = conn_flow_schema()
    src = scratch("dev_src")
    a = spark.createDataFrame(flow_rows([("C1", 10, 100), ("C2", 12, 300)]), schema)
    b = spark.createDataFrame(flow_rows([("C3", 11, 999), ("C4", 15, 200)]), schema)
    a.coalesce(1).write.parquet(src + "/a")
    b.coalesce(1).write.parquet(src + "/b")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    out, rows, ck = scratch("dev_out"), scratch("dev_rows"), scratch("dev_ck")
    st.run_deviation(stream, out, rows, ck)
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2  # two triggers
    r = st.read_latest(spark, out, ["srcIP", "destIP", "destPt", "protocol"]).first()
    want = conn_traces(a.union(b)).first()
    assert r["flowct"] == 4 and r["late_rows"] == 0
    for c in ("stdev_dest_bytes", "stdev_dest_pkts", "mean_intvl", "stdev_intvl"):
        assert r[c] == pytest.approx(want[c])
