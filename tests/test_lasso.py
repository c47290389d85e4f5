"""Lasso from moments against fits on the rows themselves."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression

from flowtrace.operators import lasso as ls
from flowtrace.operators import models as ml
from flowtrace.operators import splits as sp

FAMILIES, FEATURES = ["A", "B", "C"], ["x0", "x1", "x2", "x3", "flat"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = []
    for i in range(420):
        family = ["A"] * 40 + ["B"] * 60 + ["C"] * 20 + ["Normal"] * 300
        x = rng.normal(size=4) * [1, 50, 0.01, 1] + [0, 1000, 0, 0]
        x[3] = x[0] + 0.1 * x[3]
        bad = family[i] != "Normal"
        made.append((f"r{i}", family[i], float(bad), i % 5, *(x + bad * np.array([1.0, 20, 0, 0])).tolist(), 7.0))
    made += [("r900", "A", 1.0, 0, None, 1.0, 1.0, 1.0, 7.0), ("r901", None, None, 1, 1.0, 1.0, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(made, "row_id string, Family string, label double, fold int, x0 double, x1 double, x2 double, x3 double, flat double")
    banded, sizes = ls.with_bands(df, "row_id", FAMILIES)
    return df, banded.cache(), sizes


def _direct(x, y, lam):
    """Coordinate descent on the rows, one problem and one lambda."""
    scale = x.std(axis=0)
    z = np.where(scale > 0, (x - x.mean(axis=0)) / np.where(scale > 0, scale, 1), 0)
    r, b = y - y.mean(), np.zeros(x.shape[1])
    for _ in range(3000):
        for j in np.flatnonzero(scale > 0):
            rho = z[:, j] @ r / len(y) + b[j]
            new = np.sign(rho) * max(abs(rho) - lam, 0)
            r += z[:, j] * (b[j] - new)
            b[j] = new
    slope = b / np.where(scale > 0, scale, 1)
    return slope, y.mean() - x.mean(axis=0) @ slope


def _training(df, family):
    """The training rows of a left-out family, by the split operator, without incomplete ones."""
    part = sp.leave_family_out(df, "row_id", FAMILIES).where(f"fold_family = '{family}'").dropna(subset=FEATURES).toPandas()
    return part[part.part == "train"], part[part.part == "test"]


def test_training_rows_and_fits_without_a_family(rows):
    df, banded, sizes = rows
    fits = ls.leave_family_out_fits(banded, FEATURES, FAMILIES, sizes, folds=5)
    scored = ls.score_left_out(banded, fits, FEATURES, sizes)
    assert list(fits) == FAMILIES and sizes == {"A": 41, "B": 60, "C": 20}
    for family, fit in fits.items():
        train, test = _training(df, family)
        x, y, fold = train[FEATURES].to_numpy(), train.label.to_numpy(), train.fold.to_numpy()
        assert fit.n == len(train) and len(fit.path) == ls.STEPS
        slope, intercept = _direct(x, y, fit.chosen)
        assert np.allclose(fit.slopes, slope, atol=1e-6) and np.isclose(fit.intercept, intercept, atol=1e-6) and fit.slopes[4] == 0
        for step in (0, 30, 99):
            lam, cv, se, _ = fit.path[step]
            errors, sizes_k = [], []
            for k in range(5):
                slope, intercept = _direct(x[fold != k], y[fold != k], lam)
                errors.append(np.mean((y[fold == k] - x[fold == k] @ slope - intercept) ** 2))
                sizes_k.append((fold == k).sum())
            mean = np.average(errors, weights=sizes_k)
            assert np.isclose(cv, mean, rtol=1e-6)
            assert np.isclose(se, np.sqrt(np.average((np.array(errors) - mean) ** 2, weights=sizes_k) / 4), rtol=1e-5)
        errors = np.array([p[1] for p in fit.path])
        best = errors.argmin()
        assert fit.best == fit.path[best][0]
        assert fit.chosen == max(p[0] for p in fit.path if p[1] <= errors[best] + fit.path[best][2])
        got = {r.row_id: r for r in scored.where(f"family = '{family}'").collect()}
        assert set(got) == set(test.row_id)
        for r in test.itertuples():
            want = fit.intercept + sum(s * getattr(r, c) for s, c in zip(fit.slopes, FEATURES, strict=True))
            assert np.isclose(got[r.row_id].prob, want) and got[r.row_id].obs == r.label and got[r.row_id].pred == int(want > 0.5)


def test_errors_from_coefficients_in_sql(rows):
    """The chosen coefficients' squared error over the training rows, as moments and as SQL over the rows."""
    df, banded, sizes = rows
    fit = ls.leave_family_out_fits(banded, FEATURES, FAMILIES, sizes, folds=5)["B"]
    train, _ = _training(df, "B")
    con = duckdb.connect()
    con.register("train", train)
    terms = " + ".join([repr(fit.intercept), *(f"{s!r} * {c}" for s, c in zip(fit.slopes, FEATURES, strict=True))])
    want = con.sql(f"SELECT sum(power(label - ({terms}), 2)) FROM train").fetchall()[0][0]
    values = np.column_stack([np.ones(len(train)), train[FEATURES], train.label])
    moments = values.T @ values
    assert np.isclose(ls.squared_error(moments, np.array([*train[FEATURES].mean(), train.label.mean()]), np.array(fit.slopes)), want, rtol=1e-6)


def test_same_as_the_library_fit_at_some_lambdas(spark, rows):
    df, banded, sizes = rows
    fit = ls.leave_family_out_fits(banded, FEATURES, FAMILIES, sizes, folds=5)["A"]
    train, _ = _training(df, "A")
    data = ml.assemble(spark.createDataFrame(train[["label", *FEATURES]]), FEATURES)
    n = len(train)
    whole = np.column_stack([np.ones(n), train[FEATURES], train.label])
    count, mean, scale, correlation, covariance = ls.standardised(whole.T @ whole)
    for step in (5, 40, 80):
        lam = fit.path[step][0]
        mine = ls.solve(correlation[None], covariance[None], np.array([[lam]]))[0, 0] / np.where(scale[:-1] > 0, scale[:-1], 1)
        # the library scales by the sample deviation (divisor n - 1)
        theirs = LinearRegression(labelCol="label", regParam=lam * (n / (n - 1)) ** 0.5, elasticNetParam=1.0, tol=1e-10, maxIter=1000).fit(data)
        assert np.allclose(mine, theirs.coefficients.toArray(), rtol=2e-3, atol=2e-4)


def test_moments_of_slices_and_empty_input(spark, rows):
    df, banded, sizes = rows
    from pyspark.sql import functions as F
    whole = ls.cell_moments(df.dropna(), F.lit(3), ["x0", "x1"], [0.5, 990.0])
    parts = ls.cell_moments(df.dropna().repartition(7), F.col("fold"), ["x0", "x1"], [0.5, 990.0])
    assert np.allclose(whole[3], sum(parts.values())) and sorted(parts) == [0, 1, 2, 3, 4]
    assert ls.cell_moments(df.where("false"), F.lit(0), ["x0"], [0.0]) == {}
    assert ls.leave_family_out_fits(banded.where("false"), FEATURES, FAMILIES, sizes) == {}
