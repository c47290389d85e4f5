"""Evaluation of scored tables (label, score, prediction).

Confusion measures are one conditional-sum aggregate plus column
expressions.  ROC and AUC first aggregate to distinct scores per group, then
take running sums over them in score order with the range-sliced prefix of
:mod:`flowtrace.operators.ordered` (a global window would be one task).
Every metric has a ``group`` form so that many families, models or settings
are evaluated in one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.operators.ordered import global_prefix


def predict_at(df: DataFrame, score: str = "score", threshold: float = 0.5, out: str = "pred") -> DataFrame:
    """Class 1 where score > threshold (strict), else 0."""
    return df.withColumn(out, (F.col(score) > F.lit(threshold)).cast("int"))


def best_cuts(df: DataFrame, group: Sequence[str], label: str = "label", score: str = "score", positive=1) -> DataFrame:
    """One cut per group: where true positive rate less false positive rate is greatest along the group's ROC points.

    Rows *above* the cut are positive: it lies halfway between the best point's
    score and the next lower one of the group, and at minus infinity below the
    lowest.  Of equally good points the one with the highest score counts.
    Groups without both classes have no cut (NULL); rows of no group (NULL) give none.
    """
    group = list(group)
    points = roc_points(df, label, score, positive, group)
    gain = F.col("tpr") - F.col("fpr")
    best = points.groupBy(*group).agg(F.max_by("score", F.struct(gain, "score")).alias("at"), F.max(gain).alias("gain"))
    # the points are read once more for the next lower score, with one row per group joined to them
    its = best.withColumnsRenamed({g: "__g_" + g for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("__g_" + g))
    both = points.join(its, same)
    below = F.max(F.when(F.col("score") < F.col("at"), F.col("score")))
    cut = F.coalesce((F.max("at") + below) / 2, F.lit(float("-inf")))
    return both.groupBy(*group).agg(F.when(F.max("gain").isNotNull(), cut).alias("cut"))


def predict_by_group(df: DataFrame, cuts: DataFrame, group: Sequence[str], score: str = "score", default: float = 0.5,
                     out: str = "pred") -> DataFrame:
    """Class 1 where score > the cut of the row's group (strict), else 0.

    ``cuts``: the group columns and ``cut``, one row a group; groups without a cut
    use ``default``.  AQE broadcasts the cuts if their bytes are few.
    """
    its = cuts.select(*[F.col(g).alias("__g_" + g) for g in group], F.col("cut").alias("__cut"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col("__g_" + g))
    both = df.join(its, same, "left").withColumn(out, (F.col(score) > F.coalesce("__cut", F.lit(default))).cast("int"))
    return both.drop("__cut", *["__g_" + g for g in group])


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred", positive=1,
                     group: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn (as bigint) per group; ``positive`` names the positive class."""
    pos_l = F.col(label) == F.lit(positive)
    pos_p = F.col(pred) == F.lit(positive)
    return df.groupBy(*group).agg(
        F.count_if(pos_p & pos_l).alias("tp"), F.count_if(pos_p & ~pos_l).alias("fp"),
        F.count_if(~pos_p & pos_l).alias("fn"), F.count_if(~pos_p & ~pos_l).alias("tn"))


def _div(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion_measures(counts: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, specificity, PPV, NPV, prevalence, detection
    rate and prevalence, balanced accuracy, precision, recall, F1 from counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    sens = _div(tp, tp + fn)
    spec = _div(tn, tn + fp)
    ppv = _div(tp, tp + fp)
    npv = _div(tn, tn + fn)
    return counts.select(
        "*", _div(tp + tn, n).alias("accuracy"), sens.alias("sensitivity"), spec.alias("specificity"),
        ppv.alias("ppv"), npv.alias("npv"), _div(tp + fn, n).alias("prevalence"),
        _div(tp, n).alias("detection_rate"), _div(tp + fp, n).alias("detection_prevalence"),
        ((sens + spec) / 2).alias("balanced_accuracy"), ppv.alias("precision"), sens.alias("recall"),
        F.try_divide(2 * ppv * sens, ppv + sens).alias("f1"))


def agreement(counts: DataFrame) -> DataFrame:
    """Cohen's kappa, no-information rate and McNemar's chi-square (with
    continuity correction) from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = (tp + fp + fn + tn).cast("double")
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    disc = (fp + fn).cast("double")
    return counts.select(
        "*", F.try_divide(po - pe, 1 - pe).alias("kappa"),
        (F.greatest(tp + fn, fp + tn) / n).alias("nir"),
        F.try_divide((F.abs(fp - fn) - 1) ** 2, disc).alias("mcnemar_chi2"))


def ppv_npv_score(df: DataFrame) -> DataFrame:
    """PPV*NPV/(PPV+NPV): the value some result blocks print as "F1"."""
    return df.withColumn("ppv_npv", F.try_divide(F.col("ppv") * F.col("npv"), F.col("ppv") + F.col("npv")))


# --- tails and intervals on the (few) result rows --------------------------

def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        m2 = 2 * m
        for aa in (m * (b - m) * x / ((qam + m2) * (a + m2)),
                   -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))):
            d = 1.0 + aa * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + aa / c
            c = c if abs(c) > tiny else tiny
            de = d * c
            h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betai(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if betai(a, b, mid) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def agreement_tests(row: dict) -> dict:
    """Exact 95 % interval of accuracy (Clopper-Pearson), one-sided binomial
    P(accuracy > NIR) and McNemar p-value (chi-square, 1 df)."""
    tp, fp, fn, tn = (int(row[c]) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    x = tp + tn
    lo = 0.0 if x == 0 else beta_quantile(0.025, x, n - x + 1)
    hi = 1.0 if x == n else beta_quantile(0.975, x + 1, n - x)
    nir = max(tp + fn, fp + tn) / n
    # P(X >= x) for X ~ Binomial(n, nir) equals I_nir(x, n - x + 1)
    p_nir = 1.0 if x == 0 else betai(x, n - x + 1, nir)
    disc = fp + fn
    chi2 = ((abs(fp - fn) - 1) ** 2 / disc) if disc else float("nan")
    p_mc = math.erfc(math.sqrt(chi2 / 2)) if disc else float("nan")
    return {"acc_lower": lo, "acc_upper": hi, "p_acc_gt_nir": p_nir, "mcnemar_p": p_mc}


def with_tests(counts: DataFrame) -> DataFrame:
    """Add the tails of :func:`agreement_tests` to each row of a counts table
    (a handful of rows: one per group), computed in the executors."""
    out_cols = ["acc_lower", "acc_upper", "p_acc_gt_nir", "mcnemar_p"]
    schema = counts.schema.simpleString()[len("struct<"):-1] + "," + ",".join(f"{c}:double" for c in out_cols)

    def fn(batches):
        for pdf in batches:
            extra = pd.DataFrame([agreement_tests(r) for r in pdf.to_dict("records")], columns=out_cols)
            yield pd.concat([pdf.reset_index(drop=True), extra], axis=1)

    return counts.mapInPandas(fn, schema)


# --- ROC and AUC ------------------------------------------------------------

def score_counts(df: DataFrame, label: str = "label", score: str = "score", positive=1,
                 group: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score (per group)."""
    pos = F.col(label) == F.lit(positive)
    return df.groupBy(*group, score).agg(F.count_if(pos).cast("double").alias("pos"),
                                         F.count_if(~pos).cast("double").alias("neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", positive=1,
               group: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """One ROC point per distinct score: cut at ``score >= s``, high to low.

    Columns: group..., score, tpr, fpr.
    """
    out_group = list(group)
    df, group = _grouped(df, group)
    sc = score_counts(df, label, score, positive, group)
    # one row per group; AQE broadcasts it from its runtime size
    tot = sc.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    run = global_prefix(sc, [score], ["pos", "neg"], group, num_partitions, descending=True)
    j = run.join(tot, group)
    return j.select(*out_group, F.col(score).alias("score"), F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"),
                    F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"))


def _grouped(df: DataFrame, group: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Use a constant group when none is given, so every form is a keyed join."""
    if group:
        return df, list(group)
    return df.withColumn("__all", F.lit(0)), ["__all"]


def auc(df: DataFrame, label: str = "label", score: str = "score", positive=1, group: Sequence[str] = (),
        num_partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half (Mann-Whitney form):
    sum over scores of pos * (negatives below + neg / 2) / (P * N)."""
    group = list(group)
    sc = score_counts(df, label, score, positive, group)
    run = global_prefix(sc, [score], ["neg"], group, num_partitions)
    contrib = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    agg = run.groupBy(*group).agg(F.sum(contrib).alias("__u"), F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return agg.select(*group, F.try_divide(F.col("__u"), F.col("__p") * F.col("__n")).alias("auc"))


def metric_table(scored: DataFrame, group: Sequence[str], label: str = "label", score: str = "score",
                 pred: str = "pred", positive=1) -> DataFrame:
    """Per group: balanced accuracy, precision, recall, F1 and AUC."""
    m = confusion_measures(confusion_counts(scored, label, pred, positive, group))
    a = auc(scored, label, score, positive, group)
    return m.join(a, list(group)).select(*group, "balanced_accuracy", "precision", "recall",
                                          F.col("f1").alias("F1Score"), "auc")


def error_rates(scored: DataFrame, label: str = "label", score: str = "score", pred: str = "pred",
                positive=1, group: Sequence[str] = ()) -> DataFrame:
    """Mean misclassification error, balanced error rate and AUC."""
    out_group = list(group)
    scored, group = _grouped(scored, group)
    m = confusion_measures(confusion_counts(scored, label, pred, positive, group))
    a = auc(scored, label, score, positive, group)
    j = m.join(a, group)
    return j.select(*out_group, (1 - F.col("accuracy")).alias("mmce"),
                    (1 - F.col("balanced_accuracy")).alias("ber"), "auc")


def merge_predictions(frames: dict[str, DataFrame], keys: Sequence[str], value: str = "prob") -> DataFrame:
    """Prediction tables of several models side by side, one column per model.

    One union plus one grouped pivot (a single shuffle) instead of a chain of
    full outer joins; keys missing in a model get NULL.
    """
    long = None
    for name, df in frames.items():
        part = df.select(*keys, F.lit(name).alias("model"), F.col(value).cast("double").alias(value))
        long = part if long is None else long.unionByName(part)
    return long.groupBy(*keys).pivot("model", list(frames)).agg(F.first(value))


def melt(df: DataFrame, keys: Sequence[str], models: Sequence[str], value: str = "prob") -> DataFrame:
    """Wide prediction table to long (keys..., model, value)."""
    return df.unpivot(list(keys), list(models), "model", value)


def rows_with_prediction(df: DataFrame, model_col: str) -> DataFrame:
    """Rows where a model's prediction is present (after a merge of models)."""
    return df.where(F.col(model_col).isNotNull())
