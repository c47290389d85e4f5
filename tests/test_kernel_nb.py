"""Binned kernel densities against direct kernel sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtrace.operators import kernel_nb as kn


def _direct(x, values):
    """Gaussian kernel density at ``x`` with the usual bandwidth, without bins."""
    sd, (a, b) = values.std(ddof=1), np.quantile(values, [0.25, 0.75])
    h = 0.9 * (min(sd, (b - a) / 1.34) or sd or abs(values[0]) or 1.0) * len(values) ** -0.2
    return np.exp(-0.5 * ((x[:, None] - values) / h) ** 2).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    a, b = np.where(y == 1, rng.normal(3, 1, 500), rng.normal(0, 2, 500)), rng.exponential(1 + 4 * y)
    flat = np.where(y == 1, 5.0, 0.0)
    data = [(int(i), float(y[i]), float(a[i]), float(b[i]), float(flat[i])) for i in range(500)]
    return data, spark.createDataFrame(data, "id int, label double, a double, b double, flat double")


def test_densities_equal_kernel_sums(rows):
    data, df = rows
    model = kn.fit(df, ["a", "b", "flat"], grid=2048)
    assert model.priors == pytest.approx({y: sum(r[1] == y for r in data) / 500 for y in (0.0, 1.0)})
    for (y, c), d in model.densities.items():
        values = np.array([r[2 + ["a", "b", "flat"].index(c)] for r in data if r[1] == y])
        grid = d.low + d.step * np.arange(len(d.values))
        assert np.allclose(d.values, _direct(grid, values), atol=2e-5 / d.step ** 0.5)
        assert sum(d.values) * d.step == pytest.approx(1.0, abs=0.01)


def test_posteriors_equal_direct_ones(rows):
    data, df = rows
    model = kn.fit(df.repartition(5), ["a", "b"], grid=2048)
    got = {r.id: r.prob for r in kn.score(df, model, ["a", "b"]).collect()}
    x = np.array([r[1:4] for r in data])
    logs = [np.log((x[:, 0] == y).mean()) + sum(np.log(np.maximum(_direct(x[:, j], x[x[:, 0] == y, j]), kn.FLOOR)) for j in (1, 2)) for y in (0.0, 1.0)]
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose([got[r[0]] for r in data], want, atol=2e-3)
    assert np.mean((want > 0.5) == x[:, 0]) > 0.85


def test_nulls_far_values_and_one_class(spark, rows):
    _, df = rows
    model = kn.fit(df, ["a", "b"])
    odd = spark.createDataFrame([(1, None, None), (2, 1e9, 1.0), (3, None, 2.0)], "id int, a double, b double")
    got = {r.id: r.prob for r in kn.score(odd, model, ["a", "b"]).collect()}
    assert got[1] == pytest.approx(model.priors[1.0]) and all(0 <= p <= 1 for p in got.values())
    one = kn.fit(df.where("label = 1").withColumn("a", F.when(F.col("id") < 0, F.col("a"))), ["a", "b"])
    assert set(one.densities) == {(1.0, "b")} and {r.prob for r in kn.score(odd, one, ["a", "b"]).collect()} == {1.0}
    assert "Exchange" not in kn.score(df, model, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
