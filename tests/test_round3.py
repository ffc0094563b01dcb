"""Findings of round 3: what grew with the rows, the columns or the pairs."""

import os

import numpy as np
import pandas as pd
import pytest

from panelcast.operators import cluster, geo, impute, reshape
from panelcast.session import shared_dir


def _bytes(path: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path.removeprefix("file:")) for f in files)


def test_imputation_leaves_its_last_tables_only(spark):
    """Rows without gaps were stored once for every chain, sweep and column."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000)
    z = [None if u < 0.1 else float(v) for u, v in zip(rng.random(20_000), 2 * x + rng.normal(size=20_000))]
    df = spark.createDataFrame(list(zip(range(20_000), map(float, x), z)), "k long, x double, z double")
    before = _bytes(shared_dir(spark))
    out = impute.impute_pmm(df, ["k"], ["x", "z"], m=4, maxit=2)
    assert out.count() == 80_000 and out.where("z is null").count() == 0
    assert _bytes(shared_dir(spark)) - before < 2 * 24 * 20_000


@pytest.mark.parametrize("parts", [1, 6])
def test_donors_across_the_ends_of_stretches(spark, parts):
    """A missing row's donors are the nearest of the observed rows around its place, wherever the order is cut."""
    rng = np.random.default_rng(4)
    p, na = np.sort(rng.normal(size=300)), rng.random(300) < 0.6
    na[:9] = na[-9:] = True
    rows = [(1, float(a), bool(b), None if b else float(a), (i, None, float(rng.random())) if b else None, 0) for i, (a, b) in enumerate(zip(p, na))]
    df = spark.createDataFrame(rows, "imp int, _p double, _na boolean, _v double, _k struct<k:long,_twice:boolean,_u:double>, _r int")
    df = df.repartitionByRange(parts, "_p").sortWithinPartitions("_p").selectExpr("imp", "_p", "_na", "_v", "_k", "spark_partition_id() _r")
    got = impute._donors(df, 3).collect()
    seen = p[~na]
    decided = {r["_k"]["k"]: (r["_new"], r["_k"]["_u"]) for r in got if r["_kind"] == 0}
    waits = {r["_k"]["k"] for r in got if r["_kind"] == 1}
    assert set(decided) | waits == set(np.flatnonzero(na)) and not set(decided) & waits
    for k, (new, u) in decided.items():
        at = np.searchsorted(seen, p[k])
        near = seen[max(0, at - 3) : at + 3]
        assert new == near[np.argsort(np.abs(near - p[k]), kind="stable")[:3]][int(u * 3)]
    assert len([r for r in got if r["_kind"] == 2]) <= parts


def test_columns_of_many_entities_are_no_plan(spark):
    """One column per entity for more entities than a plan can name; a block without a cluster has no row."""
    members = spark.range(30_000).selectExpr("id as entity", "cast(id % 3 as int) as cluster")
    series = spark.createDataFrame([(c, f"2001-01-0{d}", float(10 * c + d)) for c in (0, 1) for d in (1, 2, 3)], "cluster int, ts string, value double")
    wide = reshape.entity_columns(series, members, reshape.level_order(members, "entity"))
    assert len(wide.columns) == 4 and wide.select("block").distinct().count() == 30
    rows = reshape.open_entities(wide).toPandas()
    assert len(rows) == 60_000 and (rows["value"] == rows["entity"] % 3 * 10 + rows["ts"].str[-1].astype(int)).all()


def test_neighbours_are_spread_whatever_their_positions(spark):
    """Few positions with many entities each gave all pairs of entities to the few tasks that a small shuffle gets."""
    pdf = pd.DataFrame([(i, float(i % 20), float(i // 20 % 5)) for i in range(3000)], columns=["entity", "x", "y"])
    out = geo.neighbor_join(spark.createDataFrame(pdf), 1.0)
    per_task = out.groupBy("entity").count().agg({"count": "sum"}).first()[0]
    d = np.hypot(*(pdf[["x", "y"]].to_numpy()[:100, None] - pdf[["x", "y"]].to_numpy()[None, :100]).transpose(2, 0, 1))
    assert per_task == 900 * int(((d > 0) & (d <= 1)).sum())
    tasks = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(tasks) < sum(tasks) / 4


def test_least_neighbours_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"entity": rng.permutation(200) // 2, "x": rng.integers(0, 9, 200).astype(float), "y": rng.integers(0, 9, 200).astype(float)})
    df = spark.createDataFrame(pdf)
    few = geo.neighbor_join(df, 2.0, first=4)
    want = geo.neighbor_listing(geo.neighbor_join(df, 2.0), 3).toPandas().sort_values("entity")["listing"].tolist()
    assert geo.neighbor_listing(few, 3).toPandas().sort_values("entity")["listing"].tolist() == want
    assert few.count() <= 4 * len(pdf)


def test_points_are_stored_in_a_part_for_every_core(spark):
    """A small table came in one part, so one core did every pass of k-means."""
    points = spark.range(2000).coalesce(1).selectExpr("id as entity", "0 as grp", "array(cast(id as double), 1d) as vec")
    held = cluster._spread(points, "entity")
    assert held.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    _, wss = cluster.batch_kmeans(held, {(0, 0): np.array([[999.5, 1.0]])})
    assert np.isclose(wss[0, 0], ((np.arange(2000) - 999.5) ** 2).sum())
