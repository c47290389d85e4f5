"""Naive Bayes with smooth kernel densities, fitted by binning.

For every class and feature the training values are binned linearly on a grid (a
value adds to its two neighbours by closeness) in one aggregate: a row's features
become (feature, bin) rows inside the task and are summed up before the shuffle,
so no more than classes x features x grid rows leave a task.  The Gaussian kernel's
bandwidth is 0.9 times the lesser of standard deviation and interquartile range /
1.34, times n to the power -1/5; where that is zero the deviation is taken, then
the constant's absolute value, then 1.  The grid reaches 3 bandwidths beyond the
values.  Convolution turns the bins into densities on the grid, and these are
arrays that one projection looks up for each row, with linear interpolation.

Densities below FLOOR, and values beyond the grid, count as FLOOR.  NULL values
take no part: neither in a fit nor in a row's score.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.operators.stats import exact_quantiles

GRID, CUT, FLOOR = 256, 3.0, 1e-10


@dataclass
class Density:
    low: float
    step: float
    values: list[float]


@dataclass
class KernelModel:
    """Prior of each class, and a density for each class and feature."""

    priors: dict[float, float]
    densities: dict[tuple[float, str], Density]


def bandwidth(n: int, sd: float | None, iqr: float, least: float) -> float:
    sd = sd or 0.0
    spread = min(sd, iqr / 1.34)
    return 0.9 * (spread or sd or abs(least) or 1.0) * n ** -0.2


def fit(df: DataFrame, features: Sequence[str], label: str = "label", grid: int = GRID) -> KernelModel:
    """Priors and densities of the classes of ``df``."""
    values = df.select(F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    values = values.where("label IS NOT NULL")
    long = values.unpivot(["label"], list(features), "feature", "x").where("x IS NOT NULL")
    counts = {r.label: r["count"] for r in values.groupBy("label").count().collect()}
    moments = long.groupBy("label", "feature").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    quartiles: dict[tuple[float, str], dict[float, float]] = {}
    for r in exact_quantiles(long, "x", [0.25, 0.75], ["label", "feature"]).collect():
        quartiles.setdefault((r.label, r.feature), {})[r.prob] = r.q
    shape = {}  # one entry for each class and feature
    for r in moments.collect():
        q = quartiles[r.label, r.feature]
        h = bandwidth(r.n, r.sd, q[0.75] - q[0.25], r.lo)
        shape[r.label, r.feature] = (r.n, h, r.lo - CUT * h, (r.hi - r.lo + 2 * CUT * h) / (grid - 1))
    # the bin of each value, by the grid of its class and feature: constants of the projection
    places = []
    for k, c in enumerate(features):
        at = None
        for y in counts:
            if (y, c) in shape:
                _, _, low, step = shape[y, c]
                u = (F.col(c) - F.lit(low)) / F.lit(step)
                at = F.when(F.col("label") == y, u) if at is None else at.when(F.col("label") == y, u)
        if at is not None:
            places.append(F.struct(F.lit(k).alias("f"), at.alias("u")))
    densities = {}
    if places:
        each = values.select("label", F.explode(F.array(*places)).alias("p")).where("p.u IS NOT NULL")
        bins = each.groupBy("label", "p.f", F.floor("p.u").cast("int").alias("i")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("p.u") - F.floor("p.u")).alias("up"))
        mass = {key: np.zeros(grid + 1) for key in shape}
        for r in bins.toLocalIterator():  # classes x features x grid rows at most
            held = mass[r.label, features[r.f]]
            held[r.i] += r.n - r.up
            held[r.i + 1] += r.up
        away = np.subtract.outer(np.arange(grid), np.arange(grid + 1)).astype(float)
        for key, (n, h, low, step) in shape.items():
            kernel = np.exp(-0.5 * (away * step / h) ** 2) / (n * h * math.sqrt(2 * math.pi))
            densities[key] = Density(low, step, (kernel @ mass[key]).tolist())
    total = sum(counts.values())
    return KernelModel({y: c / total for y, c in counts.items()}, densities)


def _log_density(x: F.Column, density: F.Column) -> F.Column:
    """Log density of a value; ``density`` is a struct of ``low``, ``step`` and ``values`` (NULL: adds nothing)."""
    u = (x - density["low"]) / density["step"]
    i, values = F.floor(u).cast("int"), density["values"]
    part = u - F.floor(u)
    between = F.get(values, i) * (1 - part) + F.coalesce(F.get(values, i + 1), F.lit(0.0)) * part
    inside = F.when((u >= 0) & (u <= F.size(values) - 1), between).otherwise(0.0)
    return F.when(x.isNull() | values.isNull(), 0.0).otherwise(F.log(F.greatest(inside, F.lit(FLOOR))))


def score(df: DataFrame, model: KernelModel, features: Sequence[str], positive: float = 1.0) -> DataFrame:
    """``df`` with ``prob``, the posterior of the positive class.  No join and no shuffle.

    The densities of a class are one constant array, gone through with the row's
    features side by side.
    """
    x = F.array(*[F.col(c).cast("double") for c in features])
    logs = {}
    for y, prior in sorted(model.priors.items()):
        held = [vars(model.densities[y, c]) if (y, c) in model.densities else {} for c in features]
        constant = F.from_json(F.lit(json.dumps(held)), "array<struct<low: double, step: double, values: array<double>>>")
        logs[f"__l{len(logs)}"] = (y, F.aggregate(F.zip_with(x, constant, _log_density), F.lit(math.log(prior)), lambda total, one: total + one))
    out = df.withColumns({name: total for name, (_, total) in logs.items()})
    most = F.greatest(*logs) if len(logs) > 1 else F.col(next(iter(logs)))
    parts = {name: F.exp(F.col(name) - most) for name in logs}
    own = [parts[name] for name, (y, _) in logs.items() if y == positive]
    whole = sum(parts.values(), F.lit(0.0))
    return out.withColumn("prob", (own[0] if own else F.lit(0.0)) / whole).drop(*logs)
