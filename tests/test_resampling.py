"""Search over windows, folds and bootstrap samples against NumPy on the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import resampling, splits, tune

XS, GRID = ["a", "b"], [{"lambda": 0.0}, {"lambda": 0.7}]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    n = 400
    return rng.integers(0, 2, n), rng.integers(1, 61, n), rng.normal(size=(n, 2)) * [1, 5] + [100, 0], rng.normal(size=n)


@pytest.fixture(scope="module")
def table(spark, data):
    g, idx, x, e = data
    y = x @ [2.0, -1.0] + e
    rows = [(int(g[k]), int(idx[k]), *map(float, x[k]), float(y[k]), k, k % 4) for k in range(len(g))]
    rows += [(0, 5, None, 1.0, 1.0, 1000, 1), (1, None, 1.0, 1.0, 1.0, 1001, None)]
    return spark.createDataFrame(rows, "g int, idx int, a double, b double, y double, k int, part int").repartition(4)


def plain(x, y, w, lam):
    """Ridge on standardised predictors with weights."""
    n = w.sum()
    mx, my = (w[:, None] * x).sum(0) / n, (w * y).sum() / n
    sd = np.sqrt((w[:, None] * (x - mx) ** 2).sum(0) / n)
    z = (x - mx) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z / n + lam * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - my) / n) / sd
    return np.concatenate([[my - b @ mx], b])


def compare(got, data, samples):
    """samples: fold to (weights of training, mask of test)."""
    g, _, x, e = data
    y = x @ [2.0, -1.0] + e
    assert set(got) == {(i, f, p) for i in (0, 1) for f in samples for p in (0, 1)}
    for (i, f, p), r in got.items():
        w, test = samples[f]
        w, test = w * (g == i), test & (g == i)
        coef = plain(x, y, w, GRID[p]["lambda"])
        assert r["coef"] == pytest.approx(coef, rel=1e-5, abs=1e-5)
        err, fit = y - coef[0] - x @ coef[1:], w > 0
        assert (r["n_train"], r["n_test"]) == (round(w.sum()), test.sum())
        assert r["mse_train"] == pytest.approx((w * err**2)[fit].sum() / w.sum(), rel=1e-5)
        assert (r["mse_test"], r["mae_test"]) == (pytest.approx((err[test] ** 2).mean(), rel=1e-5), pytest.approx(np.abs(err[test]).mean(), rel=1e-5))


def found(df):
    return {(r["g"], r["fold"], r["point"]): r for r in df.collect()}


@pytest.mark.parametrize("fixed", [True, False])
def test_rolling_windows(spark, table, data, fixed):
    windows = splits.time_slices(spark.range(1, 61).select(F.col("id").alias("idx")), 20, 10, 4, fixed)
    got = found(tune.grid_search(table, "y", XS, GRID, ["g"], folds=windows))
    idx = data[1]
    samples = {}
    for f in range((60 - 30) // 5 + 1):
        stop = 20 + 5 * f
        lo = stop - 19 if fixed else 1
        samples[f] = (((idx >= lo) & (idx <= stop)).astype(float), (idx > stop) & (idx <= stop + 10))
    compare(got, data, samples)


def test_columns_and_repeated_folds(table, data):
    part = np.arange(len(data[0])) % 4
    compare(found(tune.grid_search(table, "y", XS, GRID, ["g"], folds="part")), data, {f: ((part != f).astype(float), part == f) for f in range(4)})
    folds, table = resampling.KFold(["k"], 3, 2, seed=9), table.where("k < 1000")
    drawn = {(r["repeat"], r["k"]): r["fold"] for r in splits.repeated_kfold(table.select("k"), ["k"], 3, 2, 9).collect()}
    samples = {}
    for r in range(2):
        own = np.array([drawn[r, k] for k in range(len(data[0]))])
        samples |= {3 * r + f: ((own != f).astype(float), own == f) for f in range(3)}
    compare(found(tune.grid_search(table, "y", XS, GRID, ["g"], folds=folds)), data, samples)


def test_bootstrap_samples(table, data):
    table = table.where("k < 1000")
    weights = splits.bootstrap(table.select("k"), ["k"], 4, seed=3).collect()
    samples = {}
    for f in range(4):
        w = np.zeros(len(data[0]))
        for r in weights:
            if r["replicate"] == f and r["k"] < len(w):
                w[r["k"]] = r["weight"]
        samples[f] = (w, w == 0)
    results = tune.grid_search(table, "y", XS, GRID, ["g"], folds=resampling.Bootstrap(["k"], 4, seed=3))
    compare(found(results), data, samples)
    means = {(r["g"], r["point"]): r for r in resampling.over_folds(results, ["g"]).collect()}
    each = [r["mae_test"] for r in results.where("g = 1 and point = 0").collect()]
    assert means[1, 0]["mae"] == pytest.approx(np.mean(each)) and means[1, 0]["mae_sd"] == pytest.approx(np.std(each, ddof=1)) and means[1, 0]["folds"] == 4


def test_no_rows_and_no_windows(spark, table):
    none = table.limit(0)
    windows = splits.time_slices(spark.range(1, 61).select(F.col("id").alias("idx")), 20, 10, 4)
    for folds in (windows, "part", resampling.KFold(["k"]), resampling.Bootstrap(["k"])):
        assert tune.grid_search(none, "y", XS, GRID, ["g"], folds=folds).count() == 0
    assert tune.grid_search(table, "y", XS, GRID, ["g"], folds=windows.limit(0)).count() == 0
