"""Leave-one-family-out evaluation of a detector type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.operators import evaluate as ev
from flowtrace.operators import models as ml
from flowtrace.operators import splits as sp
from flowtrace.schema import MALWARE_FAMILIES, NB_DROPPED_FLAGS, SKEWED_FEATURES, feature_name

FEATURES = [feature_name(n) for n in SKEWED_FEATURES]


def _fit_score(mtype: str, train: DataFrame, test: DataFrame, features, threshold: float) -> DataFrame:
    if mtype == "nb":
        feats = [f for f in features if f not in {feature_name(c) for c in NB_DROPPED_FLAGS}]
        model = ml.gaussian_nb_fit(train, feats, "label")
        s = ml.gaussian_nb_score(test, model, feats, positive=1.0)
        return s.select("row_id", F.col("label").alias("obs"), "prob",
                        (F.col("prob") > threshold).cast("int").alias("pred"))
    if mtype == "lr":
        return ml.lasso_linear(train, test, features, fold_col="fold", threshold=threshold)[0]
    if mtype == "rf":
        return ml.random_forest(train, test, features, num_trees=30)[0]
    if mtype == "svm":
        return ml.rbf_svm(train, test, features)[0]
    if mtype == "nn":
        return ml.mlp(train, test, features)[0]
    raise ValueError(f"unknown model type {mtype!r}")


def leave_one_family_out(table: DataFrame, model: str = "nb", threshold: float = 0.5,
                         families=MALWARE_FAMILIES, features=FEATURES) -> DataFrame:
    """For each family: train on the other families plus normal rows, test on
    the family plus as many normal rows; metrics per family in one aggregate.

    The fold table is built once for all families and persisted (the loop
    reads it once per family); each fit is a distributed fit.
    """
    folds = sp.leave_family_out(table, "row_id", families).persist()
    try:
        if model == "nb":
            # all families in one fit aggregate and one scoring pass
            feats = [f for f in features if f not in {feature_name(c) for c in NB_DROPPED_FLAGS}]
            train = folds.where(F.col("part") == "train")
            test = folds.where(F.col("part") == "test")
            scored = ml.gaussian_nb_grouped(train, test, feats, ["fold_family"], positive=1.0)
            scored = scored.withColumnRenamed("fold_family", "family").withColumn(
                "pred", (F.col("prob") > threshold).cast("int"))
        else:
            scored = None
            for fam in families:
                f = folds.where(F.col("fold_family") == fam)
                s = _fit_score(model, f.where(F.col("part") == "train"), f.where(F.col("part") == "test"),
                               features, threshold).withColumn("family", F.lit(fam))
                scored = s if scored is None else scored.unionByName(s)
        out = ev.metric_table(scored, ["family"], label="obs", score="prob", pred="pred")
        return out.checkpoint(eager=True)
    finally:
        folds.unpersist()
