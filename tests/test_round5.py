"""Findings of round 4: searches and imputations that took too long, a curve that took too much disk."""

import numpy as np
import pytest

from panelcast.operators import gap, impute, smooth
from panelcast.operators.models import grove
from tests.test_round4 import _plain


@pytest.mark.parametrize("k", [1, 2, 5, 9])
def test_rows_are_looked_at_when_they_may_change(k, monkeypatch):
    """Every step of every run looked at all rows."""
    rng = np.random.default_rng(k)
    x = np.concatenate([rng.uniform(-1, 1, size=(4_000, 6)) + 50, rng.integers(49, 52, size=(500, 6))])
    h = rng.integers(-(2**62), 2**62, size=len(x))
    start = gap._starts(x, h, k, range(3))
    want, seen, calls = [_plain(x, c) for c in start], [], []
    nearest, step = gap._nearest, gap._step
    monkeypatch.setattr(gap, "PAIRS", 0)
    monkeypatch.setattr(gap, "_nearest", lambda rows, c, at=None: (seen.append(len(x) if at is None else len(at)), nearest(rows, c, at))[1])
    monkeypatch.setattr(gap, "_step", lambda *a: (calls.append(1), step(*a))[1])
    assert gap._settled(x, start.copy()) == pytest.approx(want, rel=1e-9)
    assert sum(seen) <= len(seen) * len(x) * (1 if k == 1 else 0.6) and len(calls) <= 3


def test_rows_as_near_to_two_centres_go_to_the_first():
    rows = gap._Rows(np.array([[0.0, 0.0], [4.0, 0.0], [2.0, 0.0], [2.0, 1e-9], [2.0 - 1e-9, 0.0]]))
    who, slack = gap._nearest(rows, np.array([[4.0, 0.0], [0.0, 0.0], [0.0, 0.0]]))
    assert who.tolist() == [1, 0, 0, 0, 1] and (slack <= [1e-9, 4 + 1e-6, 1e-9, 1e-9, 1e-9]).all() and slack[1] > 3.99
    who, _ = gap._nearest(rows, np.array([[4.0, 0.0], [0.0, 0.0]]), np.array([4, 1]))
    assert who.tolist() == [1, 0]


def test_draws_without_logarithms_are_the_same():
    rng = np.random.default_rng(3)
    for n in (1, 5, 3_000):
        u, weight = rng.uniform(1e-9, 1, n), rng.choice([0.0, 1e-12, 0.3, 7.0], n)
        assert gap._first_to_come(u, weight) == int((-np.log(u) / np.maximum(weight, 1e-300)).argmin())


def test_curves_read_the_panel_once(spark, monkeypatch):
    """Every pass worked the panel out again, and groups were spread over all tasks with all their sums."""
    rng = np.random.default_rng(9)
    data = [(None if e == 7 else e, None if k == 5 else 19_000 + 3 * k, float(v)) for e in range(12) for k, v in enumerate(rng.normal(size=40))]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    panel = spark.createDataFrame(data, "entity int, d int, value double").selectExpr("entity", "date_from_unix_date(d) ts", "value").repartition(5)
    counting = panel.mapInArrow(counted, panel.schema)
    got = sorted(smooth.smooth_trend(counting).dropna().collect())
    assert read.value <= 2 * len(data)  # once for the bounds of the ranges, once to store them
    assert smooth.smooth_trend(panel).count() == 11 * 40
    monkeypatch.setattr(smooth, "CURVE_NUMBERS", 0)
    assert sorted(smooth.smooth_trend(panel).dropna().collect()) == [(e, t, v, pytest.approx(s)) for e, t, v, s in got]
    t = (np.array([r[1].toordinal() for r in got if r[0] == 3]) - got[0][1].toordinal()) / 117.0
    basis = np.column_stack([np.ones(len(t)), t, t**2, t**3, *[np.maximum(0, t - k / 6) ** 3 for k in range(1, 6)]])
    value = np.array([r[2] for r in got if r[0] == 3])
    assert [r[3] for r in got if r[0] == 3] == pytest.approx(basis @ np.linalg.lstsq(basis, value, rcond=None)[0], abs=1e-6)


def test_observed_rows_travel_in_blocks(spark, monkeypatch):
    """Every observed row of every chain was shuffled and sorted as a row of its own for every draw."""
    n = 900
    rows = [(None if i % 200 == 7 else i % 850, float(i % 3), float(i % 5) if i % 4 else None, None if i % 7 == 0 else float(i % 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(4)
    shuffled, dealt = [], impute._dealt

    def looked_at(*args):
        out = dealt(*args)
        shuffled.append((out.where("_b is not null").count(), out.where("_b is null").count(), args[1].where("not _na").count() + 2 * args[0].count()))
        return out

    monkeypatch.setattr(impute, "_dealt", looked_at)
    monkeypatch.setattr(impute, "STRETCH_ROWS", 10_000)
    plain = sorted(map(str, impute.impute_pmm(df, ["k"], ["a", "b", "c"], m=2, maxit=1).collect()))
    blocks, single, observed = shuffled[0]
    assert blocks < observed / 2 and 0 < single < observed
    monkeypatch.setattr(impute, "_dealt", dealt)
    monkeypatch.setattr(impute, "STRETCH_ROWS", 90)
    monkeypatch.setattr(impute, "BLOCK_ROWS", 64)
    assert sorted(map(str, impute.impute_pmm(df, ["k"], ["a", "b", "c"], m=2, maxit=1).collect())) == plain


def test_equal_predictions_are_parted(spark):
    """Rows with one prediction come to one task unless their hashes part them."""
    rng = np.random.default_rng(2)
    n = 4_000
    p, na, h = rng.choice([1.0, 2.0, np.nan], n, p=[0.8, 0.1, 0.1]), rng.random(n) < 0.3, rng.integers(-(2**63), 2**63 - 1, n)
    order = np.lexsort((h, na, p))
    at = order[np.arange(1, 20) * n // 20]
    place = impute._place((p[at], na[at], h[at]), p, na, h)
    assert (np.diff(place[order]) >= 0).all() and np.bincount(place).tolist() == [200] * 20


def test_draws_of_a_tree_look_up_their_counts(monkeypatch):
    """The count of every row was searched for, and its hash mixed anew for every tree."""
    u = np.concatenate([np.random.default_rng(1).random(50_000), grove.SHARES[:6], np.nextafter(grove.SHARES[:6], 0), [0.0, 1 - 2.0**-53], np.arange(4096) / 4096])
    want, searched = np.searchsorted(grove.SHARES, u, side="right"), []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: (searched.append(len(v)), search(a, v, **k))[1])
    assert (grove._poisson(u) == want).all() and sum(searched) < len(u) / 50
    h = np.array([5, -3, 2**62])
    assert (grove._paired(grove._seeded(h, 42), np.array([7])) == grove.uniform(h, np.array([7]), 42)).all()
    assert grove.uniform(h, np.array([7]), 42).tolist() == pytest.approx([0.7760770557414848, 0.7923494540587485, 0.2711381388797335], abs=0)
