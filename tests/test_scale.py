"""Full-size operators against plain versions, on both sides of their limits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import cluster, gap, silhouette
from panelcast.operators.models import kernel, linear
from panelcast.operators.preprocess import Scaler
from panelcast.sources.models import ModelStore, described, score_stored
from panelcast.sources.wide_text import read_wide, write_wide


# ---- Q4 ----


@pytest.mark.parametrize("tile", [7, 1000])
def test_euclidean_silhouette(spark, tile):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    lab = [f"c{i}" for i in rng.integers(0, 4, 59)] + ["alone"]
    rows = [(k, *map(float, v), la) for k, (v, la) in enumerate(zip(x, lab))]
    table = spark.createDataFrame(rows + [(100, 1.0, None, 2.0, "c1"), (101, 1.0, 1.0, 1.0, None), (102, float("nan"), 1.0, 1.0, "c1")], "entity long, a double, b double, c double, cluster string")
    got = {r["entity"]: (r["cluster"], r["silhouette"]) for r in silhouette.silhouette_euclidean(table, ["a", "b", "c"], tile=tile).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    lab = np.array(lab)
    assert len(got) == 60
    for i in range(60):
        own = (lab == lab[i]) & (np.arange(60) != i)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        want = 0 if not own.any() else (b - d[i, own].mean()) / max(b, d[i, own].mean())
        assert got[i] == (lab[i], pytest.approx(want))
    one = silhouette.silhouette_euclidean(table.where("cluster = 'c1'"), ["a", "b", "c"], tile=tile)
    assert {r["silhouette"] for r in one.collect()} == {None}
    assert silhouette.silhouette_euclidean(table.limit(0), ["a"]).count() == 0


# ---- Q5 ----


def test_gap_by_sets_and_spread(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(15, 2)), rng.normal(size=(15, 2)) + 8, rng.normal(size=(15, 2)) + [0, 9]])
    table = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(x)], "entity long, a double, b double")
    small = gap.gap_reference(table, ["a", "b"], range(1, 5), B=12, nstart=4).orderBy("k").collect()
    large = gap.gap_reference(table, ["a", "b"], range(1, 5), B=12, nstart=4, task_numbers=0).orderBy("k").collect()
    assert [tuple(r) for r in small] == [pytest.approx(tuple(r)) for r in large]
    assert small[0]["wss"] == pytest.approx(2 * 44) and all(a["wss"] > b["wss"] for a, b in zip(small, small[1:]))
    assert max(small, key=lambda r: r["gap"])["k"] == 3
    plain = cluster.elbow(table.select("entity", *[((F.col(c) - x[:, i].mean()) / x[:, i].std(ddof=1)).alias(c) for i, c in enumerate("ab")]), ["a", "b"], [3], nstart=4).first()
    assert small[2]["wss"] == pytest.approx(plain["wss"], rel=1e-3)


def test_settled_runs_are_those_of_plain_lloyd():
    rng = np.random.default_rng(0)
    x, h = rng.normal(size=(300, 4)), rng.integers(-(2**62), 2**62, 300)
    start = gap._starts(x, h, 6, [3, 9])
    want = []
    for c in start.copy():
        while True:
            d = ((x[:, None] - c[None]) ** 2).sum(2)
            who = d.argmin(1)
            new = np.array([x[who == k].mean(0) if (who == k).any() else c[k] for k in range(6)])
            if np.abs(new - c).max() <= 1e-9 * (1 + np.abs(c).max()):
                break
            c = new
        want.append(d.min(1).sum())
    assert gap._settled(x, start) == pytest.approx(want)


# ---- A5 ----


def test_versions_of_models(spark, tmp_path):
    store = ModelStore(spark, f"{tmp_path}/models")
    with pytest.raises(FileNotFoundError):
        store.load("x")
    rows = spark.createDataFrame([(g, float(v), 3.0 * v + g, k) for g in (1, 2) for k, v in enumerate(range(20))], "g int, x double, y double, k int")
    scaler = Scaler.fit(rows, ["x"])
    scaled = scaler.transform(rows)
    first = store.save("line", described(linear.fit(scaled, "y", ["x"], ["g"], "ridge", {"lambda": 5.0}), ["x"], "ridge", scaler))
    second = store.save("line", described(linear.fit(scaled, "y", ["x"], ["g"]), ["x"], "ols", scaler))
    (tmp_path / "models" / "line" / ".draft-lost").mkdir()  # what a lost writer leaves
    (tmp_path / "models" / "line" / ".draft-lost" / "part-0.parquet").write_bytes(b"half")
    assert (first, second, store.versions("line")) == (1, 2, [1, 2])
    other = ModelStore(spark.newSession(), store.root)
    more = rows.unionByName(spark.createDataFrame([(3, 1.0, 1.0, 1), (1, None, 1.0, 1)], rows.schema))
    scored = score_stored(more, other.load("line").select("*"), ["g"])
    assert scored.columns == [*rows.columns, "prediction"]
    for r in scored.collect():
        assert r["prediction"] == (None if r["g"] == 3 or r["x"] is None else pytest.approx(3 * r["x"] + r["g"]))
    assert other.load("line", 1).first()["family"] == "ridge"
    with pytest.raises(FileNotFoundError):
        other.load("line", 7)
    with pytest.raises(ValueError):
        score_stored(more, store.load("line", 1).union(store.load("line", 2).withColumn("family", F.lit("other"))), ["g"])


def test_stored_feature_maps(spark, tmp_path):
    rows = spark.createDataFrame([(k % 2, float(k) / 10, float(k % 7), float(k * k % 11)) for k in range(80)], "g int, a double, b double, y double")
    store = ModelStore(spark, f"{tmp_path}/models")
    store.save("radial", described(kernel.kernel_ridge(rows, "y", ["a", "b"], 0.2, 0.01, ["g"], size=16), ["a", "b"], "radial", None, {"sigma": 0.2, "size": 16}))
    store.save("poly", described(kernel.poly_model(rows, "y", ["a", "b"], 2, 0.5, 0.01, ["g"]), ["a", "b"], "poly", None, {"degree": 2, "scale": 0.5}))
    want = [kernel.kernel_predict(rows, store.load("radial"), ["a", "b"], 0.2, ["g"], 16), kernel.poly_predict(rows, store.load("poly"), ["a", "b"], 2, 0.5, ["g"])]
    for name, plain in zip(("radial", "poly"), want):
        pairs = score_stored(rows, store.load(name), ["g"]).select("g", "a", "prediction").join(plain.select("g", "a", F.col("prediction").alias("p")), ["g", "a"]).collect()
        assert len(pairs) == 80 and all(r["prediction"] == pytest.approx(r["p"]) for r in pairs)


# ---- W3 ----


@pytest.mark.parametrize("block", [3, 1000])
def test_wide_lines(spark, tmp_path, block):
    rows = [(f"e{k:02d}", f"2020-01-{d:02d}", float(k * d)) for k in range(10) for d in range(1, 6) if (k + d) % 3] + [("e99", "2020-02-01", None), ("e00", "2020-03-01", 1.5)]
    table = spark.createDataFrame(rows, "entity string, ts string, value double").repartition(4)
    path = f"{tmp_path}/out"
    write_wide(table, path, block=block)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "ts," + ",".join(f"e{k:02d}" for k in range(10)) + ",e99"
    assert [line[:10] for line in lines[1:]] == [f"2020-01-{d:02d}" for d in range(1, 6)] + ["2020-02-01", "2020-03-01"]
    assert {len(line.split(",")) for line in lines} == {12}
    back = {(r["entity"], r["ts"]): float(r["value"]) for r in read_wide(spark, path).collect()}
    assert back == {(e, t): v for e, t, v in rows if v is not None}
    with pytest.raises(ValueError):
        write_wide(spark.createDataFrame([("a,b", "t", 1.0)], table.schema), f"{tmp_path}/odd")


def test_many_columns_and_none(spark, tmp_path):
    many = spark.range(30_000).select(F.col("id").alias("entity"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("ts"), (F.col("id") * 2).alias("value"))
    write_wide(many, f"{tmp_path}/many")
    lines = [line for f in sorted((tmp_path / "many").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "ts," + ",".join(map(str, range(30_000))) and lines[1:] == [t + "," + ",".join(str(2 * k) for k in range(30_000)) for t in "ab"]
    write_wide(many.limit(0), f"{tmp_path}/none")
    assert read_wide(spark, f"{tmp_path}/none").count() == 0


# ---- U2: one rule for missing numbers ----


@pytest.mark.parametrize("limit", [0, 8_000_000])
def test_scores_with_nan_by_both_ways(spark, monkeypatch, limit):
    monkeypatch.setattr(linear, "MODEL_NUMBERS", limit)
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 3.0), ("a", float("nan"), 9.0), ("a", 3.0, float("nan")), ("a", None, 1.0)], "g string, x double, y double")
    points = spark.createDataFrame([("a", 0, [0.0, 1.0])], "g string, point int, coef array<double>")
    assert [tuple(r) for r in linear.score_points(rows, "y", ["x"], points, ["g"], ["g"]).collect()] == [("a", 0, 1.0)]


# ---- L4 ----


def plain_curve(t, y, knots, lambdas):
    """Penalised splines with the whole basis matrix."""
    seg = np.minimum(np.floor(t * knots).astype(int), knots - 1)
    u = t * knots - seg
    b = np.zeros((len(t), knots + 3))
    for i, v in enumerate([(1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6, (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6]):
        b[np.arange(len(t)), seg + i] = v
    d = np.diff(np.eye(knots + 3), 2, axis=0)
    best = None
    for lam in lambdas:
        hat = b @ np.linalg.pinv(b.T @ b + lam * d.T @ d) @ b.T
        score = len(y) * ((y - hat @ y) ** 2).sum() / (len(y) - np.trace(hat)) ** 2
        if best is None or score < best[0] * (1 - 1e-9):
            best = (score, lam, hat @ y)
    return best[1:]


def test_penalised_trend(spark):
    import datetime

    rng = np.random.default_rng(3)
    days = np.arange(0, 400, 2)
    rows, curves = [], {}
    for g, f in (("wave", lambda t: 10 * np.sin(12 * t)), ("line", lambda t: 5 * t + 2)):
        y = f(days / 398) + rng.normal(size=len(days)) * 0.5
        curves[g] = y
        rows += [(g, datetime.date(2020, 1, 1) + datetime.timedelta(days=int(d)), float(v)) for d, v in zip(days, y)]
    rows += [("wave", datetime.date(2020, 1, 6), None), ("empty", datetime.date(2020, 1, 6), None)]
    from panelcast.operators import smooth

    got = smooth.penalised_trend(spark.createDataFrame(rows, "entity string, ts date, value double"), knots=12).collect()
    assert len(got) == len(rows)
    lambdas = {}
    for g, y in curves.items():
        lam, curve = plain_curve(days / 398, y, 12, smooth.LAMBDAS)
        mine = sorted((r for r in got if r["entity"] == g and r["value"] is not None), key=lambda r: r["ts"])
        assert [r["smooth"] for r in mine] == pytest.approx(curve, rel=1e-5, abs=1e-5) and {r["lambda"] for r in mine} == {lam}
        lambdas[g] = lam
    assert lambdas["line"] > lambdas["wave"]
    assert [r["smooth"] is None for r in got if r["value"] is None and r["entity"] == "empty"] == [True]
    whole = smooth.penalised_trend(spark.createDataFrame(rows, "entity string, ts date, value double"), knots=12, by=())
    assert whole.count() == len(rows) and whole.select("lambda").distinct().count() == 1


# ---- P2 ----


def test_wide_components(spark):
    from panelcast.operators.preprocess import PCAThreshold
    from panelcast.operators.wide_pca import WidePca

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 64)) + 0.3 * rng.normal(size=(300, 64))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 64)], "k int, v array<double>").repartition(5)
    flat = spark.createDataFrame([tuple(map(float, v)) for v in x], [f"c{k}" for k in range(64)])
    exact = PCAThreshold.fit(flat, flat.columns, k=8)
    for components, tol in ((64, 1e-9), (8, 2e-3)):
        found = WidePca.fit(table, "v", components)
        assert found.explained[:6] == pytest.approx(exact.explained[:6], rel=tol)
        assert np.abs(found.loadings[:, :6]) == pytest.approx(np.abs(exact.loadings[:, :6]), abs=max(tol, 1e-6) * 20)
    scores = {r["k"]: r["scores"] for r in found.transform(table, "v").collect()}
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert scores[900] is None and scores[901] is None and scores[5] == pytest.approx(z[5] @ found.loadings)
    with pytest.raises(ValueError):
        WidePca.fit(table.limit(0), "v", 2)


def test_five_thousand_columns(spark):
    from panelcast.operators.wide_pca import WidePca

    p = 5000
    wide = spark.range(0, 200, 1, 4).select(
        F.transform(F.sequence(F.lit(1), F.lit(p)), lambda j: F.sin(F.col("id") * 0.7) * F.sin(j * 0.3) * 3 + F.cos(F.col("id") * 1.3) * F.cos(j * 0.11) + (F.pmod(F.xxhash64("id", j), F.lit(1000)) / 1000.0)).alias("v")
    )
    found = WidePca.fit(wide, "v", 4)
    x = np.vstack([r["v"] for r in wide.collect()])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values = np.linalg.svd(z, compute_uv=False)[:4] ** 2 / 199 / p
    assert found.explained[:2] == pytest.approx(values[:2], rel=1e-6) and found.explained == pytest.approx(values, rel=0.2)  # the last two are noise
