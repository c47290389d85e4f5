import pytest
from pyspark.sql import functions as F

from flowtrace.operators import evaluate as ev
from flowtrace.operators import stats
from flowtrace.sources import fixture as fx
from tests.conftest import SF01


def counts_df(spark, tp, fp, fn, tn):
    return spark.createDataFrame([(tp, fp, fn, tn)], "tp long, fp long, fn long, tn long")


def test_confusion_golden(spark):
    # rows predicted (benign, malicious), columns true; benign is the positive class
    c = counts_df(spark, 2186, 9, 14, 1665)
    m = ev.confusion_measures(ev.agreement(c)).first()
    assert m["accuracy"] == pytest.approx(0.9941, abs=1e-4)
    assert m["sensitivity"] == pytest.approx(0.9936, abs=1e-4)
    assert m["specificity"] == pytest.approx(0.9946, abs=1e-4)
    assert m["kappa"] == pytest.approx(0.9879, abs=1e-4)
    assert m["mcnemar_chi2"] == pytest.approx(0.6957, abs=1e-4)
    t = ev.with_tests(c).first()
    assert t["mcnemar_p"] == pytest.approx(0.4042, abs=1e-4)
    assert (t["acc_lower"], t["acc_upper"]) == (pytest.approx(0.9911, abs=1e-4), pytest.approx(0.9962, abs=1e-4))


def test_ppv_npv_score(spark):
    # first data set, forest with mtry 6: 1056, 6 / 2, 211 -> "F1" 0.4962
    c = ev.ppv_npv_score(ev.confusion_measures(counts_df(spark, 1056, 6, 2, 211))).first()
    assert c["ppv_npv"] == pytest.approx(0.4962, abs=1e-4)


def test_confusion_counts_positive_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "label int, pred int")
    a = ev.confusion_counts(df, positive=1).first()
    b = ev.confusion_counts(df, positive=0).first()
    assert (a["tp"], a["fp"], a["fn"], a["tn"]) == (1, 0, 1, 2)
    assert (b["tp"], b["fp"], b["fn"], b["tn"]) == (2, 1, 0, 1)


def test_auc_documents(spark):
    s = fx.scored_documents(spark, SF01)
    assert s.count() == 399 and s.where("label = 1").count() == 51
    assert ev.auc(s).first()["auc"] == pytest.approx(0.541554, abs=1e-6)


def test_auc_matches_mllib_and_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = fx.scored_documents(spark, SF01).withColumn("score", F.floor(F.col("score") / 500).cast("double"))
    ours = ev.auc(s, num_partitions=7).first()["auc"]
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(
        s.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(ml, abs=1e-9)


def test_all_scores_equal_gives_half(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3)], "label int, score double")
    assert ev.auc(df).first()["auc"] == pytest.approx(0.5)


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(0, 1001).withColumn("v", (F.col("id") * 7919 % 1009).cast("double"))
    ours = {r["prob"]: r["q"] for r in stats.exact_quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0],
                                                             num_partitions=9).collect()}
    ref = df.agg(F.percentile("v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).alias("p")).first()["p"]
    for p, r in zip([0.0, 0.1, 0.25, 0.5, 0.9, 1.0], ref):
        assert ours[p] == pytest.approx(r)


def test_quantiles_rank_a_hot_value_once(spark, monkeypatch):
    seen = []
    prefix = stats.global_prefix
    monkeypatch.setattr(stats, "global_prefix", lambda df, *a, **k: (seen.append(df), prefix(df, *a, **k))[1])
    df = spark.range(20000).selectExpr("cast(if(id % 10 = 0, id % 70, 0) as double) v", "cast(id % 2 as int) g")
    probs = [0.0, 0.25, 0.5, 0.91, 0.95, 1.0]
    for group in ([], ["g"]):
        got = {(*(r[c] for c in group), r["prob"]): r["q"] for r in stats.exact_quantiles(df, "v", probs, group, 4).collect()}
        rows = df.groupBy(*group).agg(F.expr(f"percentile(v, array({', '.join(map(str, probs))}))").alias("q")).collect()
        want = {(*(r[c] for c in group), p): q for r in rows for p, q in zip(probs, r["q"])}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert [d.count() for d in seen] == [7, 8]  # different values, not rows
    assert stats.exact_quantiles(df.where("false"), "v", probs, [], 2).count() == 0


def test_cuts_of_groups_from_their_roc_points(spark):
    import math
    rows = [("a", 1, 5.0), ("a", 1, 4.0), ("a", 0, 4.0), ("a", 0, 1.0), ("a", 0, 1.0), ("b", 1, 2.0), ("b", 1, 2.0), ("b", 0, 2.0),
            ("only", 1, 3.0), (None, 1, 9.0), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    cuts = {r.g: r.cut for r in ev.best_cuts(df, ["g"]).collect()}
    # a: at 4 the rates are 1 and 1/3, at 5 they are 1/2 and 0; b: one score only, so all rows are positive
    assert cuts == {"a": 2.5, "b": -math.inf, "only": None}
    pred = ev.predict_by_group(df, ev.best_cuts(df, ["g"]), ["g"], default=3.0)
    assert sorted(((r.g, r.score, r.pred) for r in pred.collect()), key=repr) == sorted(
        [("a", 5.0, 1), ("a", 4.0, 1), ("a", 4.0, 1), ("a", 1.0, 0), ("a", 1.0, 0), ("b", 2.0, 1), ("b", 2.0, 1), ("b", 2.0, 1),
         ("only", 3.0, 0), (None, 9.0, 1), (None, 2.0, 0)], key=repr)
