"""Findings of round 3, later sittings: searches whose passes or numbers grew too fast."""

import tracemalloc

import numpy as np
import pytest

from panelcast.operators import aggregate, gap, impute
from panelcast.operators.models import tube
from panelcast.plans.tables import Tables


def _plain(x, c):
    """Lloyd's steps until the centres stay."""
    while True:
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        who = d.argmin(axis=1)
        new = np.array([x[who == j].mean(axis=0) if (who == j).any() else c[j] for j in range(len(c))])
        if np.abs(new - c).max() <= 1e-9 * (1 + np.abs(c).max()):
            return d.min(axis=1).sum()
        c = new


def test_runs_of_a_set_share_products_of_bounded_size():
    """Every run looked at its rows alone, and all runs held all rows at once."""
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, size=(20_000, 12))
    h = rng.integers(-(2**62), 2**62, size=len(x))
    start = gap._starts(x, h, 4, range(10))
    assert gap._settled(x[:700], start[:3].copy()) == pytest.approx([_plain(x[:700], c) for c in start[:3]])
    tracemalloc.start()
    gap._settled(x, start)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * x.nbytes


def test_rows_as_near_to_two_centres_count_once():
    x = np.repeat([[0.0, 0.0], [2.0, 0.0], [1.0, 0.0]], 2, axis=0)
    c = np.array([[[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]]])
    sums, n, wss = gap._step(x, (x * x).sum(axis=1), c)
    assert n.tolist() == [[4.0, 2.0, 0.0]] and sums[0].tolist() == [[2.0, 0.0], [4.0, 0.0], [0.0, 0.0]]
    assert wss.tolist() == [2.0]


def test_sums_of_a_pass_and_steps_that_stay():
    """Models that stand still were worked out three times a pass, and few models made short inner loops."""
    rng = np.random.default_rng(5)
    x, y, coef = rng.normal(size=(70, 3)), rng.normal(size=70), rng.normal(size=(3, 4))
    coef = np.stack([coef, coef, coef * [[1], [0.5], [1]]])
    assert tube._moved(coef, np.array([1.0, 1.0, np.nan])).tolist() == [[True, True, False], [False, False, False], [False, True, False]]
    cost, eps, mu = (np.array(v)[:, None] for v in ([1.0, 0.3], [0.1, 0.4], [0.05, 0.8]))
    out = np.zeros((3, tube.SUMS + 8))
    zz = np.concatenate([np.ones((1, 70)), x.T])
    for rows in (slice(0, 40), slice(40, 70)):
        tube._add(out, np.array([0, 2]), zz[:, rows], y[rows], coef[0, [0, 2]], mu, eps, cost, 3)
    r = y - coef[0, [0, 2]] @ zz
    over = np.maximum(np.abs(r) - eps, 0)
    pull = cost * np.minimum(over / mu, 1)
    loss = cost * np.where(over < mu, over**2 / (2 * mu), over - mu / 2)
    up, down = pull * (r > 0), pull * (r < 0)
    want = np.column_stack([loss.sum(1), (cost * over).sum(1), up @ y, down @ y, (up**2).sum(1), (down**2).sum(1), up @ zz.T, down @ zz.T])
    assert out[[0, 2]] == pytest.approx(want) and not out[1].any()


def test_groups_of_a_task_stay_few(spark, tmp_path, monkeypatch):
    """Parts stayed as many as the session names, so that one task's groups grew with the table."""
    lines = spark.range(6000).selectExpr("if(id % 7 = 0, null, id % 50) l_suppkey", "timestamp_seconds((id % 61) * 86400) l_shipdate", "id * 1.0D l_extendedprice")
    lines.unionByName(lines.where("l_suppkey < 3")).write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = Tables(spark, str(tmp_path)).panel
    monkeypatch.setattr(aggregate, "GROUP_ROWS", 300)
    tables = Tables(spark, str(tmp_path))
    assert tables.panel.rdd.getNumPartitions() == -(-tables.lineitem.count() // 300) > 8
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(tables.panel) == rows(plain)
    mean = impute.average_imputations(tables.panel.union(tables.panel), ["entity", "ts"], ["value"])
    assert max(mean.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) < 600
    assert rows(mean) == rows(plain)


def test_passes_read_blocks_of_whole_rows(spark):
    """Every pass read the rows one by one, with columns that it did not need."""
    rng = np.random.default_rng(6)
    rows = [(int(g), float(i), [float(v) for v in rng.normal(size=2)]) for i, g in enumerate(np.repeat([7, 9], [300, 5]))]
    rows += [(9, float("nan"), [1.0, 2.0]), (7, 1.0, [float("nan"), 2.0])]
    df = spark.createDataFrame([(g, 0, "train", y, x) for g, y, x in rows], "g long, h long, split string, y double, x array<double>").coalesce(1)
    blocks, _ = tube._blocks(df, 2)
    assert blocks.count() < 8
    back = [(g, *v) for g, x, y in tube._unpacked(iter(blocks.toArrow().combine_chunks().to_batches()), 2) for v in np.column_stack([y, x]).tolist()]
    assert sorted(back) == sorted((g, y, *x) for g, y, x in rows[:-2])
