"""Feature preparation and detectors on trace tables.

Scalers and Gaussian naive Bayes are written as aggregates plus column
expressions (so they can be checked by SQL); the other detectors are MLlib
estimators, fitted distributedly.  Only fitted parameters (a handful of numbers
per feature) ever reach the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# scalers and transforms (aggregate + expressions)
# ---------------------------------------------------------------------------


def _stats_row(df: DataFrame, aggs) -> dict:
    """One aggregate row (a few numbers per column) to the driver."""
    return df.agg(*aggs).first().asDict()


def center(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """x - mean(x) per column (fit: one aggregate pass)."""
    m = _stats_row(df, [F.avg(c).alias(c) for c in cols])
    return df.withColumns({c: F.col(c) - F.lit(m[c]) for c in cols})


def range_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min) per column; a constant column becomes 0.5."""
    s = _stats_row(df, [F.min(c).alias("lo_" + c) for c in cols] + [F.max(c).alias("hi_" + c) for c in cols])
    out = {}
    for c in cols:
        lo, hi = s["lo_" + c], s["hi_" + c]
        out[c] = F.lit(0.5) if hi == lo else (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(out)


LAMBDA_GRID = [round(-2.0 + 0.1 * i, 1) for i in range(41)]


def box_cox_lambdas(df: DataFrame, cols: Sequence[str], grid: Sequence[float] = LAMBDA_GRID) -> DataFrame:
    """Box-Cox lambda per column by profile log-likelihood over a grid.

    One pass: the columns are unpivoted and every value is paired with every
    lambda inside the row (``explode``); a single aggregate gives n, the
    variance of y and sum log x per (column, lambda).  Columns with a value <= 0 are
    left out (not transformable).  Output: field, bc_lambda, loglik.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "field", "x")
    long = long.where(F.col("x").isNotNull())
    lam = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("lam")
    y = (F.when(F.col("x") <= 0, F.lit(None)).when(F.col("lam") == 0, F.log("x"))
         .otherwise((F.pow("x", F.col("lam")) - 1) / F.col("lam")))
    per = (long.select("field", "x", lam).groupBy("field", "lam")
           .agg(F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("var"),
                F.sum(F.when(F.col("x") > 0, F.log("x"))).alias("slx"), F.min("x").alias("xmin")))
    ll = -F.col("n") / 2 * F.log("var") + (F.col("lam") - 1) * F.col("slx")
    scored = per.where(F.col("xmin") > 0).select("field", F.col("lam").alias("bc_lambda"), ll.alias("loglik"))
    best = scored.groupBy("field").agg(F.max_by("bc_lambda", "loglik").alias("bc_lambda"),
                                       F.max("loglik").alias("loglik"))
    return best


def box_cox_apply(df: DataFrame, lambdas: dict[str, float]) -> DataFrame:
    out = {}
    for c, lam in lambdas.items():
        out[c] = F.log(c) if lam == 0 else (F.pow(F.col(c), F.lit(lam)) - 1) / F.lit(lam)
    return df.withColumns(out)


# ---------------------------------------------------------------------------
# Gaussian naive Bayes (aggregates + expressions)
# ---------------------------------------------------------------------------

def gaussian_nb_fit(df: DataFrame, features: Sequence[str], label: str = "label",
                    var_floor: float = 1e-9) -> dict:
    """Per class: prior, mean and population variance (+ floor) of each feature."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"),
                                 *[F.avg(c).alias("m_" + c) for c in features],
                                 *[F.var_pop(c).alias("v_" + c) for c in features]).collect()
    total = sum(r["__n"] for r in rows)
    return {r[label]: {"prior": r["__n"] / total,
                       "m": {c: r["m_" + c] for c in features},
                       "v": {c: (r["v_" + c] or 0.0) + var_floor for c in features}} for r in rows}


def gaussian_nb_score(df: DataFrame, model: dict, features: Sequence[str], positive=1) -> DataFrame:
    """``prob`` = posterior of the positive class (log densities, then softmax).

    The per-class log densities are materialised as columns first, so each
    (one sum over the features) is built once; repeating them inside
    ``greatest``/``exp`` would grow the expression tree the optimizer walks.
    """
    if positive not in model:
        return df.withColumn("prob", F.lit(0.0))
    classes = [positive] + [c for c in model if c != positive]
    lp_cols = {}
    for i, cls in enumerate(classes):
        p = model[cls]
        e = F.lit(math.log(p["prior"]))
        for c in features:
            v = p["v"][c]
            e = e - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(c) - F.lit(p["m"][c])) ** 2 / F.lit(2 * v)
        lp_cols[f"__lp{i}"] = e
    names = list(lp_cols)
    staged = df.select("*", *[e.alias(n) for n, e in lp_cols.items()])
    mx = F.greatest(*[F.col(n) for n in names]) if len(names) > 1 else F.col(names[0])
    staged = staged.withColumn("__mx", mx)
    den = None
    for n in names:
        term = F.exp(F.col(n) - F.col("__mx"))
        den = term if den is None else den + term
    return staged.withColumn("prob", F.exp(F.col(names[0]) - F.col("__mx")) / den).drop(*names, "__mx")


def gaussian_nb_grouped(train: DataFrame, test: DataFrame, features: Sequence[str], group: Sequence[str],
                        label: str = "label", id_col: str = "row_id", positive=1,
                        var_floor: float = 1e-9) -> DataFrame:
    """Gaussian naive Bayes fitted and applied per group (e.g. per left-out
    family) in one pass each: one grouped aggregate gives every group's
    class priors, means and variances; test rows are unpivoted to
    (row, feature, x), joined to that parameter table (groups x classes x
    features rows) and summed to per-class log densities.

    Output: group..., ``row_id``, ``obs``, ``prob`` (positive class).
    """
    group, features = list(group), list(features)
    stats = train.groupBy(*group, label).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.avg(c).alias("m__" + c) for c in features], *[F.var_pop(c).alias("v__" + c) for c in features])
    tot = F.sum("__n").over(Window.partitionBy(*group))
    stats = stats.withColumn("__logprior", F.log(F.col("__n") / tot))
    params = stats.select(
        *group, F.col(label).alias("__cls"), "__logprior",
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col("m__" + c).alias("m"),
                                     (F.coalesce(F.col("v__" + c), F.lit(0.0)) + var_floor).alias("v"))
                            for c in features])).alias("p")).select(*group, "__cls", "__logprior", "p.*")
    long = test.select(*group, F.col(id_col).alias("row_id"), F.col(label).alias("obs"),
                       *[F.col(c).cast("double").alias(c) for c in features]) \
        .unpivot(group + ["row_id", "obs"], features, "feature", "x")
    dens = long.join(params, group + ["feature"]).groupBy(*group, "row_id", "obs", "__cls", "__logprior").agg(
        F.sum(-0.5 * F.log(2 * math.pi * F.col("v")) - (F.col("x") - F.col("m")) ** 2 / (2 * F.col("v")))
        .alias("__ll"))
    dens = dens.withColumn("__lp", F.col("__ll") + F.col("__logprior"))
    per_row = dens.groupBy(*group, "row_id", "obs").agg(
        F.max("__lp").alias("__mx"),
        F.max(F.when(F.col("__cls") == F.lit(positive), F.col("__lp"))).alias("__lpos"),
        F.collect_list(F.col("__lp")).alias("__lps"))  # one entry per class
    den = F.aggregate("__lps", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("__mx")))
    return per_row.select(*group, "row_id", "obs",
                          F.coalesce(F.exp(F.col("__lpos") - F.col("__mx")) / den, F.lit(0.0)).alias("prob"))


def histogram_nb_grouped(train: DataFrame, test: DataFrame, features: Sequence[str], group: Sequence[str] = (),
                         label: str = "label", id_col: str = "row_id", positive=1, bins: int = 32,
                         smoothing: float = 1.0) -> DataFrame:
    """Naive Bayes with per-class histogram densities (the "kernel" form:
    a density estimate instead of one normal per class and feature).

    Per (group, feature) the training range is cut into ``bins`` equal bins;
    one aggregate counts (class, feature, bin); the full (class, feature,
    bin) grid comes from ``explode(sequence(...))`` so empty bins get the
    smoothing mass.  Test rows are unpivoted, binned with the same edges and
    joined to the density table; log densities sum per class, then softmax.
    Output: group..., ``row_id``, ``obs``, ``prob``.
    """
    group, features = list(group), list(features)
    if not group:  # a constant group keeps every join keyed
        train, test = train.withColumn("__all", F.lit(0)), test.withColumn("__all", F.lit(0))
    gkey = group or ["__all"]
    tr_long = train.select(*gkey, F.col(label).alias("__cls"),
                           *[F.col(c).cast("double").alias(c) for c in features]) \
        .unpivot(gkey + ["__cls"], features, "feature", "x").where(F.col("x").isNotNull())
    rng = tr_long.groupBy(*gkey, "feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))

    def bin_of(x):
        span = F.col("hi") - F.col("lo")
        b = F.when(span > 0, F.floor((x - F.col("lo")) / span * bins)).otherwise(F.lit(0))
        return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")

    binned = tr_long.join(rng, gkey + ["feature"]).withColumn("bin", bin_of(F.col("x")))
    counts = binned.groupBy(*gkey, "__cls", "feature", "bin").agg(F.count(F.lit(1)).alias("k"))
    cls_n = train.groupBy(*gkey, F.col(label).alias("__cls")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(*gkey))
    cls_n = cls_n.withColumn("__logprior", F.log(F.col("n") / tot))
    grid = cls_n.join(rng, gkey).select(*gkey, "__cls", "n", "__logprior", "feature", "lo", "hi",
                                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    dens = grid.join(counts, gkey + ["__cls", "feature", "bin"], "left").select(
        *gkey, "__cls", "__logprior", "feature", "bin",
        F.log((F.coalesce(F.col("k"), F.lit(0)) + smoothing) / (F.col("n") + smoothing * bins) / width)
        .alias("__ld"))
    te_long = test.select(*gkey, F.col(id_col).alias("row_id"), F.col(label).alias("obs"),
                          *[F.col(c).cast("double").alias(c) for c in features]) \
        .unpivot(gkey + ["row_id", "obs"], features, "feature", "x").where(F.col("x").isNotNull())
    te_b = te_long.join(rng, gkey + ["feature"]).withColumn("bin", bin_of(F.col("x"))).drop("x", "lo", "hi")
    lp = te_b.join(dens, gkey + ["feature", "bin"]).groupBy(*gkey, "row_id", "obs", "__cls", "__logprior") \
        .agg(F.sum("__ld").alias("__ll")).withColumn("__lp", F.col("__ll") + F.col("__logprior"))
    per_row = lp.groupBy(*gkey, "row_id", "obs").agg(
        F.max("__lp").alias("__mx"),
        F.max(F.when(F.col("__cls") == F.lit(positive), F.col("__lp"))).alias("__lpos"),
        F.collect_list("__lp").alias("__lps"))  # one entry per class
    den = F.aggregate("__lps", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("__mx")))
    return per_row.select(*group, "row_id", "obs",
                          F.coalesce(F.exp(F.col("__lpos") - F.col("__mx")) / den, F.lit(0.0)).alias("prob"))


# ---------------------------------------------------------------------------
# MLlib detectors
# ---------------------------------------------------------------------------

def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def prob_of_one(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col)).getItem(1)


def scored_frame(pred: DataFrame, id_col: str, label: str, prob: F.Column, threshold: float = 0.5) -> DataFrame:
    """Prediction frame: row id, observed class, probability, predicted class."""
    return pred.select(F.col(id_col).alias("row_id"), F.col(label).alias("obs"), prob.alias("prob"),
                       (prob > F.lit(threshold)).cast("int").alias("pred"))


#: Fits at a time of a cross-validation: tails and driver steps of one overlap with tasks of the others.
PARALLEL_FITS = 4


def forest(label="label", **params) -> RandomForestClassifier:
    """A random forest that keeps each row's node in every tree, so that a level takes one
    step a row and tree, not the way down from the root.  The trees are the same."""
    return RandomForestClassifier(featuresCol="features", labelCol=label, cacheNodeIds=True, **params)


def random_forest(train: DataFrame, test: DataFrame, features, label="label", id_col="row_id",
                  num_trees=50, max_depth=12, subset="sqrt", seed=11, fold_col: str | None = None,
                  subsets: Sequence[str] | None = None, trees: Sequence[int] | None = None):
    """Random forest; with ``fold_col`` the feature-subset size (and tree
    count) are tuned by cross-validated AUC.  Returns (scored test, model)."""
    rf = forest(label, numTrees=num_trees, maxDepth=max_depth, featureSubsetStrategy=subset, seed=seed)
    tr = assemble(train, features)
    if fold_col:
        grid = ParamGridBuilder()
        if subsets:
            grid = grid.addGrid(rf.featureSubsetStrategy, list(subsets))
        if trees:
            grid = grid.addGrid(rf.numTrees, list(trees))
        cv = CrossValidator(estimator=rf, estimatorParamMaps=grid.build(),
                            evaluator=BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC"),
                            foldCol=fold_col, parallelism=PARALLEL_FITS, collectSubModels=False)
        model = cv.fit(tr).bestModel
    else:
        model = rf.fit(tr)
    pred = model.transform(assemble(test, features))
    return scored_frame(pred, id_col, label, prob_of_one()), model


def cv_predictions(df: DataFrame, features: Sequence[str], settings: Sequence[dict], make, label="label",
                   id_col="row_id", fold_col="fold") -> DataFrame:
    """Out-of-fold predictions for every parameter setting (k-fold CV with the
    predictions kept): for each setting and fold, fit on the other folds and
    score the held-out fold.  Each fit is distributed; the result is one
    table with the setting's parameters as columns.

    ``make(**setting)`` returns an MLlib classifier using ``features``/``label``.
    """
    data = assemble(df, features).select(id_col, label, fold_col, "features").cache()
    try:
        folds = sorted(r[0] for r in data.select(fold_col).distinct().collect())
        out = None
        for setting in settings:
            for f in folds:
                model = make(**setting).fit(data.where(F.col(fold_col) != f))
                pred = model.transform(data.where(F.col(fold_col) == f))
                part = scored_frame(pred, id_col, label, prob_of_one()).select(
                    "*", F.lit(f).alias("fold"), *[F.lit(v).alias(k) for k, v in setting.items()])
                out = part if out is None else out.unionByName(part)
        return out.checkpoint(eager=True)
    finally:
        data.unpersist()


def decision_tree(train, test, features, label="label", id_col="row_id", max_depth=10, seed=11):
    dt = DecisionTreeClassifier(featuresCol="features", labelCol=label, maxDepth=max_depth, seed=seed)
    model = dt.fit(assemble(train, features))
    return scored_frame(model.transform(assemble(test, features)), id_col, label, prob_of_one()), model


def logistic(train, test, features, label="label", id_col="row_id", reg=0.0):
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=100)
    model = lr.fit(assemble(train, features))
    return scored_frame(model.transform(assemble(test, features)), id_col, label, prob_of_one()), model


def mlp(train, test, features, label="label", id_col="row_id", hidden=(10, 5), seed=11, max_iter=200):
    """Range-scaled inputs, then a small multilayer perceptron."""
    lo_hi = MinMaxScaler(inputCol="raw", outputCol="features")
    net = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label,
                                         layers=[len(features), *hidden, 2], seed=seed, maxIter=max_iter)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"),
                            lo_hi, net])
    model = pipe.fit(train)
    return scored_frame(model.transform(test), id_col, label, prob_of_one()), model


def lasso_path(train: DataFrame, features, label="label", fold_col="fold", lambdas=None,
               k: int | None = None) -> tuple[float, list[tuple[float, float, float]]]:
    """Lasso linear fit on 0/1 labels over a lambda grid, chosen by the
    one-standard-error rule: the largest lambda whose cross-validated mean
    squared error is within one standard error of the best.

    Returns (chosen lambda, [(lambda, cv mse, its standard error)]).  Each
    fold's fit is a distributed MLlib fit; only errors reach the driver.
    """
    lambdas = lambdas or [0.1 * (0.5 ** i) for i in range(8)]
    folds = sorted(r[0] for r in train.select(fold_col).distinct().collect())
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse")
    data = assemble(train, features).select("features", label, fold_col).cache()
    rows = []
    try:
        for lam in lambdas:
            errs = []
            for f in folds:
                fit = LinearRegression(featuresCol="features", labelCol=label, regParam=lam, elasticNetParam=1.0,
                                       standardization=True, maxIter=50).fit(data.where(F.col(fold_col) != f))
                errs.append(ev.evaluate(fit.transform(data.where(F.col(fold_col) == f))))
            mean = sum(errs) / len(errs)
            se = (sum((e - mean) ** 2 for e in errs) / max(len(errs) - 1, 1)) ** 0.5 / len(errs) ** 0.5
            rows.append((lam, mean, se))
    finally:
        data.unpersist()
    best = min(rows, key=lambda r: r[1])
    chosen = max(r[0] for r in rows if r[1] <= best[1] + best[2])
    return chosen, rows


def lasso_linear(train, test, features, label="label", id_col="row_id", fold_col="fold", threshold=0.5):
    lam, _ = lasso_path(train, features, label, fold_col)
    model = LinearRegression(featuresCol="features", labelCol=label, regParam=lam, elasticNetParam=1.0,
                             standardization=True, maxIter=100).fit(assemble(train, features))
    pred = model.transform(assemble(test, features))
    return scored_frame(pred, id_col, label, F.col("prediction"), threshold), model


def random_fourier(df: DataFrame, features: Sequence[str], dim: int = 64, gamma: float = 0.5, seed: int = 11,
                   out: str = "rff") -> DataFrame:
    """Random Fourier features of an RBF kernel exp(-gamma |x - y|^2)
    (Rahimi & Recht 2007): sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), as a
    vector column.  One numpy matrix product per Arrow batch (a pandas UDF);
    written as column expressions it would be dim x features terms for the
    code generator."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), (len(features), dim))
    b = rng.uniform(0.0, 2 * math.pi, dim)
    scale = math.sqrt(2.0 / dim)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        X = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, len(features)))
        Z = scale * np.cos(X @ W + b)
        return pd.Series(list(Z))

    arr = F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn(out, array_to_vector(project(arr)))


def rbf_svm(train, test, features, label="label", id_col="row_id", dim=64, gamma=0.5, reg=0.01, seed=11):
    """Approximate radial SVM: random Fourier features -> linear SVM -> Platt
    scaling (a logistic fit on the margin) for class probabilities.

    The projected training vectors are checkpointed once: the solver passes
    over them once per iteration, and recomputing the projection (dim x
    features terms per row) each time would dominate.
    """
    tr = random_fourier(train.select(id_col, label, *features), features, dim, gamma, seed, "features")
    te = random_fourier(test.select(id_col, label, *features), features, dim, gamma, seed, "features")
    tr = tr.select(id_col, label, "features").checkpoint(eager=True)
    te = te.select(id_col, label, "features")
    svm = LinearSVC(featuresCol="features", labelCol=label, regParam=reg, maxIter=50).fit(tr)

    def with_margin(d):
        m = svm.transform(d).withColumn("margin", vector_to_array(F.col("rawPrediction")).getItem(1))
        return VectorAssembler(inputCols=["margin"], outputCol="m").transform(
            m.select(id_col, label, "margin"))

    platt = LogisticRegression(featuresCol="m", labelCol=label).fit(with_margin(tr))
    scored = platt.transform(with_margin(te))
    return scored_frame(scored, id_col, label, prob_of_one()), (svm, platt)


def glm_binomial(df: DataFrame, features: Sequence[str], label="label"):
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=label,
                                      maxIter=50)
    return glm.fit(assemble(df, features))


def glm_aic(df: DataFrame, features: Sequence[str], label="label") -> tuple[float, float]:
    """(AIC, deviance) of a binomial GLM; an intercept-only fit when no features."""
    if not features:
        stats = df.agg(F.avg(label).alias("p"), F.count(F.lit(1)).alias("n")).first()
        p, n = stats["p"], stats["n"]
        dev = -2 * n * (p * math.log(p) + (1 - p) * math.log(1 - p)) if 0 < p < 1 else 0.0
        return dev + 2, dev
    s = glm_binomial(df, features, label).summary
    return s.aic, s.deviance


def stepwise_aic(df: DataFrame, features: Sequence[str], label="label", max_steps: int | None = None) -> list[tuple]:
    """Both-direction stepwise choice by AIC from the full model.

    Each candidate is one distributed GLM fit; the loop over candidates is
    on the driver (few terms).  It ends when no step lowers the AIC, as each
    must, or after ``max_steps`` if given.  Returns [(step, action, term, aic)].
    """
    current = list(features)
    aic, _ = glm_aic(df, current, label)
    out = [(0, "start", "", aic)]
    data = df.select(*features, label).cache()
    try:
        for step in itertools.islice(itertools.count(1), max_steps):
            cands = [("drop", t, [c for c in current if c != t]) for t in current]
            cands += [("add", t, current + [t]) for t in features if t not in current]
            scored = [(glm_aic(data, cols, label)[0], act, t, cols) for act, t, cols in cands]
            best = min(scored, key=lambda r: r[0])
            if best[0] >= aic - 1e-9:
                break
            aic, current = best[0], best[3]
            out.append((step, best[1], best[2], aic))
    finally:
        data.unpersist()
    return out


def deviance_table(df: DataFrame, features: Sequence[str], label="label") -> list[tuple]:
    """Sequential analysis of deviance: add terms in order; deviance drop and
    its chi-square (1 df) tail.  Returns [(term, df, deviance, resid_dev, p)]."""
    rows = []
    _, prev = glm_aic(df, [], label)
    rows.append(("NULL", None, None, prev, None))
    for i, t in enumerate(features):
        _, dev = glm_aic(df, list(features[: i + 1]), label)
        drop = prev - dev
        p = math.erfc(math.sqrt(max(drop, 0.0) / 2)) if drop is not None else None
        rows.append((t, 1, drop, dev, p))
        prev = dev
    return rows
