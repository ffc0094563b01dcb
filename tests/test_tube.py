"""Epsilon-insensitive regression against exact minima of small problems."""

from __future__ import annotations

import numpy as np
import pytest

from panelcast.operators.models import tube

KEYS = ["k"]


def loss(b0, b, x, y, cost, eps):
    return 0.5 * b * b + cost * np.maximum(np.abs(y - b0 - b * x) - eps, 0).sum()


def inner(b, x, y, cost, eps):
    """Least value over the intercept: piecewise linear, so at a corner."""
    r = y - b * x
    corners = np.concatenate([r - eps, r + eps])
    return min(loss(c, b, x, y, cost, eps) for c in corners)


def least(x, y, cost, eps):
    """Golden section over the slope of the convex inner minimum."""
    lo, hi, ratio = -50.0, 50.0, (5**0.5 - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = inner(a, x, y, cost, eps), inner(b, x, y, cost, eps)
    while hi - lo > 1e-7:
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - ratio * (hi - lo)
            fa = inner(a, x, y, cost, eps)
        else:
            lo, a, fa = a, b, fb
            b = lo + ratio * (hi - lo)
            fb = inner(b, x, y, cost, eps)
    return min(fa, fb)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    n = 120
    g = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 2))
    y = 3 * x[:, 0] - 2 * g + rng.standard_t(2, size=n) * 0.3
    return g, x, y


@pytest.fixture(scope="module")
def table(spark, data):
    g, x, y = data
    rows = [(int(a), *map(float, b), float(c), "train" if k % 4 else "test", k) for k, (a, b, c) in enumerate(zip(*data, strict=True))]
    rows += [(0, None, 1.0, 2.0, "train", 1000), (1, float("nan"), 1.0, 2.0, "train", 1001), (2, 1.0, 1.0, None, "train", 1002), (7, 1.0, 1.0, 1.0, "test", 1003)]
    return spark.createDataFrame(rows, "g int, a double, b double, y double, split string, k int").repartition(3)


POINTS = [{"cost": c, "epsilon": e} for c in (0.1, 10.0) for e in (0.0, 0.4)]


def test_grid_reaches_the_least_objective(table, data):
    models, scores = tube.tube_search(table, "y", ["a"], ["g"], POINTS, KEYS, tol=1e-4)
    got = {(r["g"], r["point"]): r for r in models.collect()}
    g, x, y = data
    train = np.arange(len(g)) % 4 > 0
    assert len(got) == 12
    for (i, k), r in got.items():
        at = train & (g == i)
        want = least(x[at, 0], y[at], POINTS[k]["cost"], POINTS[k]["epsilon"])
        assert r["bound"] <= want * (1 + 1e-9) and want <= r["objective"] * (1 + 1e-9)
        assert r["objective"] <= want * (1 + 2e-4)
        assert loss(*r["coef"], x[at, 0], y[at], POINTS[k]["cost"], POINTS[k]["epsilon"]) == pytest.approx(r["objective"])
    for r in scores.where("split = 'test' and g < 3").collect():
        at = ~train & (g == r["g"])
        b0, b = got[r["g"], r["point"]]["coef"]
        assert (r["n"], r["mae"]) == (at.sum(), pytest.approx(np.abs(y[at] - b0 - b * x[at, 0]).mean()))


def test_feature_maps_and_slices(table, data, monkeypatch):
    points = [{"sigma": 0.5, "cost": 2.0, "epsilon": 0.1}, {"degree": 2, "scale": 0.5, "cost": 2.0, "epsilon": 0.1}, {"cost": 2.0, "epsilon": 0.1}]
    whole = {(r["g"], r["point"]): r for r in tube.tube_fit(table, "y", ["a", "b"], ["g"], points, KEYS, "split", size=12).collect()}
    g, x, y = data
    train = np.arange(len(g)) % 4 > 0
    for (i, k), r in whole.items():
        at = train & (g == i)
        z = tube.feature_map(points[k], 2, 12)(x[at])
        assert z.shape[1] + 1 == len(r["coef"]) == (13, 6, 3)[k]
        b0, b = r["coef"][0], np.array(r["coef"][1:])
        own = 0.5 * b @ b + 2 * np.maximum(np.abs(y[at] - b0 - z @ b) - 0.1, 0).sum()
        assert own == pytest.approx(r["objective"]) and r["objective"] - r["bound"] <= 1e-3 * r["objective"] + 1e-9
    from panelcast.operators.models import grove

    monkeypatch.setattr(grove, "MODEL_NUMBERS", 1000)
    parts = tube.tube_fit(table, "y", ["a", "b"], ["g"], points, KEYS, "split", size=12).collect()
    assert {(r["g"], r["point"]) for r in parts} == set(whole)
    assert all(r["objective"] == pytest.approx(whole[r["g"], r["point"]]["objective"], rel=3e-3) for r in parts)


def test_no_rows_constant_target_and_raising(spark, table, monkeypatch):
    assert tube.tube_fit(table.limit(0), "y", ["a"], ["g"], POINTS, KEYS, "split").count() == 0
    flat = spark.createDataFrame([(float(k), 4.0, k) for k in range(20)], "a double, y double, k int")
    r = tube.tube_fit(flat, "y", ["a"], [], POINTS[:1], KEYS).first()
    assert r["objective"] == pytest.approx(0, abs=1e-9) and r["coef"][0] == pytest.approx(4)
    monkeypatch.setattr(tube, "PASSES", 2)
    with pytest.raises(ArithmeticError):
        tube.tube_fit(table, "y", ["a"], ["g"], POINTS, KEYS, "split")
