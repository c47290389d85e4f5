"""Lasso fits from moments: leave-one-family-out and cross-validation in one pass over the rows.

A lasso fit needs of its rows only their number and the sums of all products of
two columns.  One pass adds these up for every cell of (family, fold, band of
normal rows); the training rows of any left-out family and fold are then sums of
cells.  No row is copied, and the fits (a 100-step path for every family and
fold) run on matrices of the number of features.

The normal rows tested with a family are as many as the family has, the first by
hash; a normal row's band says how many families are smaller than its rank, so it
is a training row of exactly these.

As usual for this fit: predictors are scaled to unit variance (divisor n), the
objective is half the mean squared error plus lambda times the absolute weights,
lambdas run from the least one without any weight down to 0.0001 of it (0.01 if
there are fewer rows than features) in equal steps of the logarithm, and the one
chosen is the largest whose cross-validated error is within one standard error of
the least.  Constant columns have no weight.  Rows with a null or NaN in any
column take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.functions.exprs import hash_order
from flowtrace.operators.dataset import complete_cases
from flowtrace.operators.ordered import global_prefix
from flowtrace.schema import NORMAL_FAMILY

STEPS, TOLERANCE, MOST_SWEEPS = 100, 1e-9, 10_000
#: Partial sums of the tasks are added up in so many groups for each cell, then to one.
MERGE_GROUPS = 256


def with_bands(df: DataFrame, id_col: str, families: Sequence[str], family_col: str = "Family",
               seed=11) -> tuple[DataFrame, dict[str, int]]:
    """``df`` with ``band``, and the number of rows of each family.

    ``band`` of a normal row: how many of the families have fewer rows than its
    rank.  0 for other rows.  Rows of other families than the given ones and
    ``Normal`` stay too (they are training rows always).
    """
    found = df.where(F.col(family_col).isin(list(families))).groupBy(family_col).count().collect()
    sizes = {f: 0 for f in families} | {r[family_col]: r["count"] for r in found}  # one number a family
    normal = F.col(family_col) == NORMAL_FAMILY
    ranked = global_prefix(df.where(normal).withColumn("__h", hash_order(seed, id_col)), ["__h"])
    below = [F.when(F.col("rank") > F.lit(n), 1).otherwise(0) for n in sizes.values()]
    band = below[0]
    for b in below[1:]:
        band = band + b
    normals = ranked.withColumn("band", band).drop("__h", "rank")
    return normals.unionByName(df.where(~normal | F.col(family_col).isNull()).withColumn("band", F.lit(0))), sizes


def tested_with(sizes: dict[str, int], family_col: str = "Family") -> F.Column:
    """The left-out families that a row of :func:`with_bands` is a test row of (an array, mostly empty)."""
    tests = []
    for f, n in sizes.items():
        smaller = sum(o < n for o in sizes.values())
        own = F.col(family_col) == f
        tests.append(F.when(own | ((F.col(family_col) == NORMAL_FAMILY) & (F.col("band") <= smaller)), F.lit(f)))
    return F.array_compact(F.array(*tests))


def _added(rows: pa.Table) -> pa.Table:
    sums = rows.column("moments").combine_chunks()
    total = sums.flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
    return pa.table({"cell": rows.column("cell")[:1], "moments": pa.array([total.tolist()], pa.list_(pa.float64()))})


def cell_moments(df: DataFrame, cell: F.Column, columns: Sequence[str], about: Sequence[float]) -> dict[int, np.ndarray]:
    """For each cell the sums of products of two of (1, columns...), the columns taken about fixed points.

    Tasks add up their rows; cells are as few as the caller's classes, so what
    comes to the driver is a matrix for each.
    """
    shift = np.array([0.0, *about])
    size = len(columns) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            values = np.column_stack([np.ones(batch.num_rows), *(batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(size - 1))]) - shift
            for c in np.unique(cells).tolist():
                mine = values[cells == c]
                held[c] = held.get(c, 0.0) + mine.T @ mine
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int64()), pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))],
                names=["cell", "moments"])

    rows = df.select(cell.cast("bigint").alias("cell"), *(F.col(c).cast("double").alias(c) for c in columns))
    schema = "cell bigint, moments array<double>"
    some = rows.mapInArrow(partial, schema).withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
    merged = some.groupBy("cell", "part").applyInArrow(lambda rows: _added(rows), schema).groupBy("cell").applyInArrow(lambda rows: _added(rows), schema)
    return {r.cell: np.array(r.moments).reshape(size, size) for r in merged.collect()}


def standardised(moments: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, scales, correlation of the predictors, their covariance with the response by scale) of sums about any point.

    The response is the last column.  A constant column has scale 0.
    """
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(cov).copy()
    var[var <= 1e-12 * np.maximum(1.0, np.diag(moments)[1:] / n)] = 0.0
    scale = np.sqrt(var)
    safe = np.where(scale > 0, scale, np.inf)[:-1]
    return n, mean, scale, cov[:-1, :-1] / np.outer(safe, safe), cov[:-1, -1] / safe


def lambda_path(covariance: np.ndarray, n: float, steps: int = STEPS) -> np.ndarray:
    most = float(np.abs(covariance).max(initial=0.0))
    ratio = 1e-4 if n > len(covariance) else 1e-2
    return np.geomspace(most, most * ratio, steps) if most > 0 else np.zeros(steps)


def solve(correlation: np.ndarray, covariance: np.ndarray, lambdas: np.ndarray) -> np.ndarray:
    """Weights on the unit scale for problems side by side: (problem, step, feature).

    Cyclic coordinate descent along each problem's lambdas, from the weights of
    the step before; all problems move together.
    """
    problems, features = covariance.shape
    weights, path = np.zeros((problems, features)), np.zeros((problems, lambdas.shape[1], features))
    usable = np.einsum("bjj->bj", correlation) > 0.5  # a constant column's row is zero
    for step in range(lambdas.shape[1]):
        for _ in range(MOST_SWEEPS):
            moved = 0.0
            for j in range(features):
                rest = covariance[:, j] - np.einsum("bk,bk->b", correlation[:, j], weights) + weights[:, j]
                new = np.where(usable[:, j], np.sign(rest) * np.maximum(np.abs(rest) - lambdas[:, step], 0.0), 0.0)
                moved = max(moved, float(np.abs(new - weights[:, j]).max()))
                weights[:, j] = new
            if moved < TOLERANCE:
                break
        path[:, step] = weights
    return path


def squared_error(moments: np.ndarray, mean: np.ndarray, slope: np.ndarray) -> float:
    """Sum of squared errors of (y - mean_y) ~ slope (x - mean_x) over the rows of ``moments``."""
    w = np.concatenate([[-mean[-1] + mean[:-1] @ slope], -slope, [1.0]])
    return float(w @ moments @ w)


@dataclass
class LassoFit:
    """A fit chosen by the one-standard-error rule; ``path`` rows are (lambda, mean error, its standard error, weights)."""

    n: int
    chosen: float
    best: float
    intercept: float
    slopes: list[float]
    path: list[tuple[float, float, float, int]]


def _fit(whole: np.ndarray, folds: list[np.ndarray], about: np.ndarray, paths: np.ndarray, lambdas: np.ndarray) -> LassoFit:
    """Choose along the paths of the whole rows (first) and of all but one fold (the others)."""
    n, mean, scale, _, _ = standardised(whole)
    slopes = lambda m, path: path / np.where(m[:-1] > 0, m[:-1], 1.0)
    errors, sizes = np.zeros((len(folds), len(lambdas))), np.array([f[0, 0] for f in folds])
    for k, held in enumerate(folds):
        _, fold_mean, fold_scale, _, _ = standardised(whole - held)
        for step, slope in enumerate(slopes(fold_scale, paths[k + 1])):
            errors[k, step] = squared_error(held, fold_mean, slope) / held[0, 0]
    weight = sizes / sizes.sum()
    cv = weight @ errors
    se = np.sqrt(weight @ (errors - cv) ** 2 / max(len(folds) - 1, 1))
    best = int(np.argmin(cv))
    chosen = int(np.flatnonzero(cv <= cv[best] + se[best])[0])  # lambdas fall
    slope = slopes(scale, paths[0])[chosen]
    intercept = mean[-1] + about[-1] - (mean[:-1] + about[:-1]) @ slope
    kept = (paths[0] != 0).sum(axis=1)
    return LassoFit(int(n), float(lambdas[chosen]), float(lambdas[best]), float(intercept), slope.tolist(),
                    [(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(lambdas, cv, se, kept, strict=True)])


def training_moments(cells: dict[int, np.ndarray], names: Sequence[str], families: Sequence[str], sizes: dict[str, int],
                     folds: int) -> dict[str, list[np.ndarray]]:
    """For each left-out family the sums over its training rows, fold by fold.

    Cells are numbered as :func:`cell_number` does.
    """
    bands = len(families) + 1
    smaller = {f: sum(n < sizes[f] for n in sizes.values()) for f in families}
    shape = next(iter(cells.values())).shape
    out = {f: [np.zeros(shape) for _ in range(folds)] for f in families}
    for number, moments in cells.items():
        rest, band = divmod(number, bands)
        name, fold = divmod(rest, folds)
        for f in families:
            # a normal row is in training if its rank is beyond the family's rows: more families are smaller than its rank
            if names[name] != f and (names[name] != NORMAL_FAMILY or band > smaller[f]):
                out[f][fold] += moments
    return out


def cell_number(names: Sequence[str], families: Sequence[str], folds: int, family_col: str = "Family") -> F.Column:
    """Number of a row's cell: its place among ``names``, its fold and its band."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(family_col)) - 1
    return (place * folds + F.col("fold")) * (len(families) + 1) + F.col("band")


def leave_family_out_fits(df: DataFrame, features: Sequence[str], families: Sequence[str], sizes: dict[str, int],
                          label: str = "label", folds: int = 10, family_col: str = "Family") -> dict[str, LassoFit]:
    """A fit without each family of ``df`` (with ``band`` and ``fold``), from one pass over the rows."""
    columns = [*features, label]
    rows = complete_cases(df.where(F.col(family_col).isNotNull()), columns)
    about = np.array([v or 0.0 for v in rows.agg(*[F.avg(c) for c in columns]).first()])
    names = sorted(r[0] for r in df.select(family_col).distinct().where(F.col(family_col).isNotNull()).collect())
    cells = cell_moments(rows, cell_number(names, families, folds), columns, about)
    training = training_moments(cells, names, families, sizes, folds) if cells else {}
    usable, wholes, parts, lambdas = [], [], [], []
    for f, by_fold in training.items():
        whole, held = sum(by_fold), [m for m in by_fold if m[0, 0] > 0]
        if whole[0, 0] < 2 or len(held) < 2:
            continue  # nothing to learn from, or nothing to choose by
        n, _, _, _, covariance = standardised(whole)
        usable.append(f)
        wholes.append(whole)
        parts.append(held)
        lambdas.append(lambda_path(covariance, n))
    problems = [(standardised(m), i) for i, (whole, held) in enumerate(zip(wholes, parts, strict=True)) for m in [whole, *(whole - h for h in held)]]
    if not problems:
        return {}
    paths = solve(np.array([p[3] for p, _ in problems]), np.array([p[4] for p, _ in problems]), np.array([lambdas[i] for _, i in problems]))
    owner = np.array([i for _, i in problems])
    return {f: _fit(wholes[i], parts[i], about, paths[owner == i], lambdas[i]) for i, f in enumerate(usable)}


def score_left_out(df: DataFrame, fits: dict[str, LassoFit], features: Sequence[str], sizes: dict[str, int],
                   threshold: float = 0.5, label: str = "label", id_col: str = "row_id", family_col: str = "Family") -> DataFrame:
    """``family``, ``row_id``, ``obs``, ``prob``, ``pred`` of every test row of every left-out family.

    All families' scores are columns of one projection; a row is handed on once
    for each family that tests it.
    """
    order = list(sizes)
    tested = []
    for f, fit in fits.items():
        score = F.lit(fit.intercept)
        for c, s in zip(features, fit.slopes, strict=True):
            if s:
                score = score + F.lit(s) * F.col(c)
        smaller = sum(sizes[o] < sizes[f] for o in order)
        is_test = (F.col(family_col) == f) | ((F.col(family_col) == NORMAL_FAMILY) & (F.col("band") <= smaller))
        tested.append(F.when(is_test, F.struct(F.lit(f).alias("family"), score.alias("prob"))))
    rows = complete_cases(df, [*features, label])
    each = rows.select(F.col(id_col).alias("row_id"), F.col(label).alias("obs"), F.explode(F.array_compact(F.array(*tested))).alias("t"))
    return each.select("t.family", "row_id", "obs", "t.prob", (F.col("t.prob") > threshold).cast("int").alias("pred"))
