"""Operators against brute force on small tables, including the paths for large and skewed groups."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions import student
from panelcast.functions.student import t_two_sided
from panelcast.operators import cluster, correlate, distribution, forecast, geo, impute, joins, moments, ordering, rank, select, splits, tune, window
from panelcast.operators.models import kernel, linear, svr, tree
from panelcast.operators.preprocess import PCAThreshold, Scaler
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.reshape import factor_levels
from panelcast.plans import catalog

RNG = np.random.default_rng(7)
XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def reg(spark):
    n = 600
    pdf = pd.DataFrame(RNG.normal(size=(n, 3)), columns=XS)
    pdf["c"] += 0.5 * pdf["a"]
    pdf["g"] = np.where(np.arange(n) % 3 == 0, "u", "v")
    pdf["y"] = 5 + 2 * pdf["a"] - pdf["b"] + np.where(pdf["g"] == "u", 1.5, -0.5) * pdf["c"] + RNG.normal(scale=0.3, size=n)
    pdf["id"] = np.arange(n)
    pdf["split"] = np.where(pdf["id"] < 400, "train", np.where(pdf["id"] < 500, "val", "test"))
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


@pytest.mark.parametrize("task_rows", [10**6, 50, 0])
def test_quantiles_with_a_hot_group_ties_and_tails(spark, task_rows):
    hot = np.concatenate([np.zeros(3000), RNG.normal(size=3000), 1e6 * RNG.pareto(1.0, 1500)])
    pdf = pd.concat([pd.DataFrame({"g": 1, "x": hot}), pd.DataFrame({"g": 2, "x": RNG.normal(size=37)}), pd.DataFrame({"g": 3, "x": [4.0]})])
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    out = exact_quantiles(spark.createDataFrame(pdf).repartition(7), ["g"], "x", probs, [f"q{i}" for i in range(6)], task_rows).toPandas()
    for _, row in out.iterrows():
        want = np.quantile(pdf.loc[pdf.g == row["g"], "x"], probs)
        assert np.allclose(row[[f"q{i}" for i in range(6)]].to_numpy(dtype=float), want, rtol=1e-12, atol=1e-12)
    assert len(out) == 3


def test_spread_quantiles_of_the_whole_column(spark):
    x = RNG.lognormal(sigma=3, size=50_000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = exact_quantiles(df, [], "x", [0.01, 0.5, 0.999], ["a", "b", "c"], task_rows=1000).first()
    assert np.allclose(list(got), np.quantile(x, [0.01, 0.5, 0.999]), rtol=1e-12)


def _series(n_hot=1500, n=40):
    day = dt.date(2000, 1, 1)
    rows = [("hot", day + dt.timedelta(days=i), float(RNG.normal())) for i in range(n_hot)]
    rows += [("e2", day + dt.timedelta(days=3 * i), float(RNG.normal())) for i in range(n)]
    return pd.DataFrame(rows, columns=["entity", "ts", "value"])


def test_lags_and_centred_mean_across_blocks(spark):
    pdf = _series()
    df = spark.createDataFrame(pdf).repartition(6)
    got = window.add_lags(df, 7, 3).toPandas().sort_values(["entity", "ts"])
    want = pdf.sort_values(["entity", "ts"]).copy()
    for k in (7, 14, 21):
        want[f"value_lag_{k}"] = want.groupby("entity")["value"].shift(k)
    want = want[want.groupby("entity").cumcount() >= 21]
    assert np.allclose(got[["value", "value_lag_7", "value_lag_14", "value_lag_21"]], want[["value", "value_lag_7", "value_lag_14", "value_lag_21"]])
    mean = window.centered_mean(df, 9).toPandas().sort_values(["entity", "ts"])["trend"].to_numpy()
    roll = pdf.sort_values(["entity", "ts"]).groupby("entity")["value"].transform(lambda s: s.rolling(9, center=True).mean()).to_numpy()
    assert np.allclose(mean, roll, equal_nan=True)


def test_ranks_of_a_part_full_of_ties(spark):
    pdf = pd.DataFrame({"p": ["x"] * 900 + ["y"] * 30, "v": [0.0] * 800 + list(range(100)) + list(range(30)), "e": range(930)})
    out = rank.rank_first(spark.createDataFrame(pdf).repartition(9), ["p"], [F.desc("v"), F.asc("e")]).toPandas()
    want = pdf.sort_values(["p", "v", "e"], ascending=[True, False, True]).assign(rank=lambda d: d.groupby("p").cumcount() + 1)
    both = out.merge(want, on=["p", "e"])
    assert (both["rank_x"] == both["rank_y"]).all()


def test_gram_narrow_wide_weighted_and_shifted(spark, reg):
    pdf, df = reg
    w = df.withColumn("w", F.col("id") % 4 + 1.0)
    for cols in (["a", "y"], [*XS, "y", *[f"z{k}" for k in range(12)]]):
        src = w.withColumns({c: F.col("a") * k for k, c in enumerate(c for c in cols if c.startswith("z"))})
        cells = moments.gram(src, cols, ["g"], [0.5] * len(cols), "w").toPandas()
        for g, part in pdf.groupby("g"):
            x = np.column_stack([np.ones(len(part))] + [(part["a"] * int(c[1:]) if c.startswith("z") else part[c]) - 0.5 for c in cols])
            want = (x * (part["id"] % 4 + 1).to_numpy()[:, None]).T @ x
            assert np.allclose(moments.gram_matrix(cells[cells.g == g], len(cols) + 1), want)


def test_linear_models_against_numpy(spark, reg):
    pdf, df = reg
    models = {r["g"]: r["coef"] for r in linear.fit(df, "y", XS, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        x = np.column_stack([np.ones(len(part)), part[XS]])
        want = np.linalg.lstsq(x, part["y"], rcond=None)[0]
        assert np.allclose(models[g], want, atol=1e-8)
    pls = {r["g"]: r["coef"] for r in linear.fit(df, "y", XS, ["g"], "pls", {"ncomp": 3}).collect()}
    boost = {r["g"]: r["coef"] for r in linear.fit(df, "y", XS, ["g"], "boost", {"steps": 5000, "rate": 0.1}).collect()}
    enet = {r["g"]: r["coef"] for r in linear.fit(df, "y", XS, ["g"], "elastic_net", {"lambda": 1e-9, "alpha": 0.5}).collect()}
    for g in models:
        for other in (pls, boost, enet):
            assert np.allclose(models[g], other[g], atol=1e-5)


def test_elastic_net_meets_its_optimality_conditions():
    r, c = np.array([[1.0, 0.6], [0.6, 1.0]]), np.array([0.9, 0.2])
    p = {"lambda": 0.1, "alpha": 0.7}
    b = linear.SOLVERS["elastic_net"](r, c, p)
    grad = c - r @ b - p["lambda"] * (1 - p["alpha"]) * b
    for g, v in zip(grad, b):
        assert abs(g) <= 0.07 + 1e-8 if v == 0 else np.isclose(g, np.sign(v) * 0.07, atol=1e-7)


def test_grid_errors_come_out_of_the_moments(spark, reg):
    pdf, df = reg
    out = tune.grid_search(df, "y", XS, [{"lambda": 0.0}, {"lambda": 1.0}], ["g"]).toPandas()
    for _, r in out.iterrows():
        part = pdf[(pdf.g == r["g"]) & (pdf.split == "val")]
        e = part["y"] - (r["coef"][0] + part[XS].to_numpy() @ np.array(r["coef"][1:]))
        assert np.isclose((e**2).mean(), r["mse_val"]) and np.isclose(e.abs().mean(), r["mae_val"])


def test_ridge_cv_prefers_little_shrinkage_and_can_share_lambda(spark, reg):
    _, df = reg
    own = linear.ridge_cv(df, "y", XS, [1e-4, 10.0], ["id"], ["g"]).toPandas()
    assert (own["lambda"] == 1e-4).all()
    shared = linear.ridge_cv(df, "y", XS, [1e-4, 10.0], ["id"], ["g"], shared_lambda="mean").toPandas()
    assert shared["lambda"].nunique() == 1


def test_prediction_does_not_depend_on_partitions(spark, reg):
    _, df = reg
    a = linear.fit(df.repartition(1), "y", XS, ["g"]).orderBy("g").first()["coef"]
    b = linear.fit(df.repartition(13), "y", XS, ["g"]).orderBy("g").first()["coef"]
    assert np.allclose(a, b)


def test_svr_ignores_the_tube_and_beats_the_mean(spark, reg):
    pdf, df = reg
    coef = np.array(svr.linear_svr(df, "y", XS, ["g"], cost=10.0, epsilon=0.2).where("g = 'u'").first()["coef"])
    part = pdf[pdf.g == "u"]

    def loss(c):
        r = np.abs(part["y"] - c[0] - part[XS].to_numpy() @ c[1:]) - 0.2
        return 0.5 * c[1:] @ c[1:] + 10 * (np.clip(r, 0, None) ** 2).sum()

    best = loss(coef)
    for k in range(4):
        for d in (-1e-3, 1e-3):
            assert loss(coef + d * np.eye(4)[k]) >= best - 1e-6


def test_radial_and_polynomial_models_learn_a_curve(spark):
    x = RNG.uniform(-2, 2, 800)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.sin(2 * x), "q": x * x}))
    k = kernel.kernel_predict(df, kernel.kernel_ridge(df, "y", ["x"], 1.0, 1e-4), ["x"], 1.0).toPandas()
    assert ((k["prediction"] - k["y"]) ** 2).mean() < 0.01
    p = kernel.poly_predict(df, kernel.poly_model(df, "q", ["x"], 2, lam=1e-8), ["x"], 2).toPandas()
    assert ((p["prediction"] - p["q"]) ** 2).mean() < 1e-6


def test_trees_beat_the_mean(spark, reg):
    _, df = reg
    out = tree.tree_grid(df, "y", XS, [{"mtry": 2, "trees": 10, "depth": 5}]).first()
    assert out["mse_val"] < df.agg(F.var_samp("y")).first()[0]


def test_pvalues():
    # two-sided tails of published t tables
    assert np.allclose(t_two_sided([12.706, 2.228, 1.96, 0.0], [1, 10, 1e7, 5]), [0.05, 0.05, 0.05, 1.0], atol=2e-4)
    assert t_two_sided([np.inf], [3])[0] == 0


def test_correlation_with_gaps(spark):
    m = RNG.normal(size=(300, 3))
    m[RNG.random((300, 3)) < 0.2] = np.nan
    pdf = pd.DataFrame(m, columns=list("abc"))
    want = pdf.corr()
    for r in correlate.correlation_matrix(spark.createDataFrame(pdf), list("abc")).collect():
        assert np.isclose(r["r"], want.loc[r["a"], r["b"]])


def test_pca_shares_and_orthogonal_scores(spark, reg):
    pdf, df = reg
    pca = PCAThreshold.fit(df, XS, 0.99)
    assert np.allclose(pca.explained, np.sort(np.linalg.eigvalsh(pdf[XS].corr()))[::-1] / 3)
    s = pca.transform(df, ["id"]).toPandas()[pca.names]
    assert np.allclose(s.cov(), np.diag(np.diag(s.cov())), atol=1e-8)


def test_neighbors_with_crowded_cells_and_coincident_points(spark, monkeypatch):
    monkeypatch.setattr(geo, "SALT_ROWS", 5)
    pdf = pd.DataFrame({"entity": range(160), "x": RNG.uniform(0, 30, 160), "y": RNG.uniform(0, 30, 160)})
    pdf.loc[100:, ["x", "y"]] = 15.0
    out = geo.neighbor_join(spark.createDataFrame(pdf), 7.0)
    d = np.hypot(*(pdf[["x", "y"]].to_numpy()[:, None] - pdf[["x", "y"]].to_numpy()[None]).transpose(2, 0, 1))
    want = {(i, j) for i, j in zip(*np.where((d > 0) & (d <= 7)))}
    rows = [(r["entity"], r["neighbor"]) for r in out.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pmm_fills_with_observed_values_only(spark):
    pdf = pd.DataFrame({"k": range(400), "x": RNG.normal(size=400)})
    pdf["z"] = np.round(3 * pdf["x"] + RNG.normal(scale=0.1, size=400), 3)
    truth = pdf["z"].copy()
    pdf.loc[RNG.random(400) < 0.25, "z"] = np.nan
    src = spark.createDataFrame(pdf).withColumn("z", F.nanvl("z", F.lit(None).cast("double")))
    out = impute.impute_pmm(src, ["k"], ["x", "z"], m=2, maxit=2).toPandas()
    assert len(out) == 800 and out["z"].notna().all()
    seen = set(pdf["z"].dropna())
    for _, part in out.groupby("imp"):
        part = part.sort_values("k").reset_index(drop=True)
        held = pdf["z"].notna()
        assert (part.loc[held, "z"] == pdf.loc[held, "z"]).all() and set(part.loc[~held, "z"]) <= seen
        assert np.abs(part["z"] - truth)[~held].mean() < 0.6
    avg = impute.average_imputations(spark.createDataFrame(out), ["k"], ["z"])
    assert avg.count() == 400


def test_kmeans_finds_blobs_and_more_centres_never_hurt(spark):
    c = np.array([[0, 0], [10, 0], [0, 10]])
    pdf = pd.DataFrame(np.repeat(c, 30, axis=0) + RNG.normal(scale=0.3, size=(90, 2)), columns=["x", "y"])
    pdf["entity"] = range(90)
    df = spark.createDataFrame(pdf)
    labels, wss = cluster.kmeans(df, ["x", "y"], 3, nstart=5)
    got = labels.toPandas().sort_values("entity")["cluster"].to_numpy()
    assert set(got) == {1, 2, 3} and all(len(set(got[i * 30 : i * 30 + 30])) == 1 for i in range(3))
    e = cluster.elbow(df, ["x", "y"], [1, 2, 3]).orderBy("k").toPandas()["wss"]
    assert (e.diff().dropna() <= 1e-9).all() and np.isclose(e.iloc[-1], wss)
    gap = cluster.gap_statistic(df, ["x", "y"], [1, 2, 3, 4], B=10).orderBy("k").toPandas()["gap"]
    assert gap.idxmax() >= 2


def test_block_recursion_equals_the_daily_loop(spark):
    n, h, step, times = 80, 17, 5, 3
    v = [float(z) for z in RNG.normal(size=n)]
    day = dt.date(2010, 1, 1)
    hist = spark.createDataFrame([(1, day + dt.timedelta(days=i), x) for i, x in enumerate(v)], "cluster int, ts date, value double")
    x = RNG.normal(size=h)
    new = spark.createDataFrame([(1, day + dt.timedelta(days=n + i), float(x[i])) for i in range(h)], "cluster int, ts date, x double")
    coef = [0.3, 1.1, 0.5, -0.2, 0.1]
    models = spark.createDataFrame([(1, coef)], "cluster int, coef array<double>")
    got = forecast.forecast_recursive(hist, new, models, ["x"], step, times).orderBy("ts").toPandas()["prediction"]
    for i in range(h):
        v.append(coef[0] + coef[1] * x[i] + sum(coef[2 + k] * v[n + i - step * (k + 1)] for k in range(times)))
    assert np.allclose(got, v[n:])


def test_kfold_and_bootstrap(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    folds = splits.repeated_kfold(df, ["k"], 5, 3)
    assert folds.count() == 15000 and folds.groupBy("k", "repeat").count().where("count <> 1").count() == 0
    sizes = folds.groupBy("repeat", "fold").count().toPandas()["count"]
    assert len(sizes) == 15 and sizes.between(850, 1150).all()
    w = splits.bootstrap(df, ["k"], 4).groupBy("replicate").agg(F.sum("weight").alias("n"), F.count("*").alias("m")).toPandas()
    assert w["n"].between(4700, 5300).all() and w["m"].between(3000, 3330).all()


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": RNG.normal(size=2000)}))
    out = distribution.kde(df, "x", 256).orderBy("point").toPandas()
    assert abs(np.trapezoid(out["density"], out["x"]) - 1) < 0.02


def test_scaler_passes_other_columns_and_constants(spark, reg):
    _, df = reg
    out = Scaler.fit(df.withColumn("one", F.lit(3.0)), ["a", "one"]).transform(df.withColumn("one", F.lit(3.0)))
    r = out.agg(F.avg("a"), F.stddev_samp("a"), F.max("one"), F.count_distinct("g")).first()
    assert np.allclose([r[0], r[1], r[2], r[3]], [0, 1, 0, 2])


def test_factor_levels_refuses_instead_of_cutting(spark):
    with pytest.raises(ValueError):
        factor_levels(spark.range(20), "id", limit=10)


@pytest.mark.parametrize("name", ["g2_add_lags", "g3_centered_mean", "g4_row_index", "m1_decompose", "f3_entity_profile"])
def test_no_window_over_all_rows_of_the_panel(spark, sf_dir, name):
    """A window without partition keys may only run over the table of calendar years."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "], [" not in line.split("windowspecdefinition", 1)[1].split("AS", 1)[-1]:
            assert "_y" in line


def test_date_index_counts_every_date_once(spark):
    pdf = _series(800, 10)
    out = ordering.row_index(spark.createDataFrame(pdf)).select("ts", "idx").distinct().toPandas().sort_values("ts")
    assert list(out["idx"]) == list(range(1, len(out) + 1))


# ---- rules that must not depend on sizes, and groups without information ----


def _gappy(spark, width):
    rng = np.random.default_rng(9)
    x = rng.normal(size=600)
    holes = np.where(rng.random(600) < 0.3, np.nan, x)
    pdf = pd.DataFrame({f"f{k}": rng.normal(size=600) for k in range(width)})
    pdf["f0"] = holes
    pdf["y"] = x + 3 * np.isnan(pdf["f0"]) + 0.1 * np.random.default_rng(8).normal(size=600)
    return spark.createDataFrame(pdf), [f"f{k}" for k in range(width)]


@pytest.mark.parametrize("score", [select.importance_nonpara, select.importance_linear])
def test_nan_is_missing_at_any_number_of_columns(spark, score):
    got = []
    for width in (40, 41):
        df, names = _gappy(spark, width)
        got.append({r["feature"]: r["score"] for r in score(df, "y", names).collect()})
    assert all(np.isclose(got[0][f], got[1][f]) for f in got[0])
    kept = df.where(~F.isnan("f0"))
    assert np.isclose(got[1]["f0"], score(kept, "y", ["f0"]).first()["score"])


def test_any_row_can_be_a_starting_centre(spark):
    points = spark.range(6000).select("id", F.lit(0).alias("grp"), F.array(F.col("id").cast("double")).alias("vec"))
    starts = cluster.starting_centers(points, {(0, r): 1 for r in range(200)}, "id", 1)
    drawn = np.array([c[0, 0] for c in starts.values()])
    assert len(set(drawn.tolist())) > 150 and drawn.min() < 600 and drawn.max() > 5400


def test_kmeans_returns_the_wss_of_its_centres_or_raises(spark):
    x = np.random.default_rng(4).normal(size=(500, 2))
    points = spark.createDataFrame([(0, v.tolist()) for v in x], "grp int, vec array<double>")
    centers, wss = cluster.batch_kmeans(points, {(0, 0): x[:5], (0, 1): x[5:12]})
    for run, c in centers.items():
        assert np.isclose(wss[run], ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    with pytest.raises(ArithmeticError):
        cluster.batch_kmeans(points, {(0, 0): x[:5]}, max_iter=2)


def test_forecast_keeps_a_row_without_predictor(spark):
    day = dt.date(2020, 1, 1)
    hist = spark.createDataFrame([(1, day + dt.timedelta(days=i), float(i)) for i in range(10)], "cluster int, ts date, value double")
    new = spark.createDataFrame([(1, day + dt.timedelta(days=10 + i), None if i == 1 else 0.0) for i in range(4)], "cluster int, ts date, x double")
    models = spark.createDataFrame([(1, [0.0, 1.0, 1.0])], "cluster int, coef array<double>")
    got = [(r["ts"].day, r["prediction"]) for r in forecast.forecast_recursive(hist, new, models, ["x"], 2, 1).orderBy("ts").collect()]
    assert [g[0] for g in got] == [11, 12, 13, 14] and got[0][1] == 8.0 and got[2][1] == 8.0
    assert all(g[1] is None or np.isnan(g[1]) for g in (got[1], got[3]))


@pytest.mark.parametrize("by", [["g"], []])
def test_svr_shrinks_inside_the_tube(spark, by):
    rows = [("line", float(i) / 10, 2.0 * i / 10) for i in range(-10, 11)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = svr.linear_svr(df, "y", ["x"], by, cost=100.0, epsilon=0.5).collect()
    assert len(got) == 1
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def loss(a, b):
        return 0.5 * b * b + 100 * (np.clip(np.abs(y - a - b * x) - 0.5, 0, None) ** 2).sum()

    a, b = got[0]["coef"]
    assert b < 1.6 and np.isclose(got[0]["objective"], loss(a, b))
    assert loss(a, b) <= min(loss(p, q) for p in np.linspace(-0.1, 0.1, 21) for q in np.linspace(1.3, 2.0, 141)) + 1e-6


@pytest.mark.parametrize("width", [357, 1000])
def test_scores_of_wide_models(spark, width):
    rng = np.random.default_rng(width)
    x, coef = rng.normal(size=(5, width)), rng.normal(size=width + 1)
    names = [f"x{k}" for k in range(width)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(g="a"))
    models = spark.createDataFrame([("a", coef.tolist())], "g string, coef array<double>")
    got = np.sort(linear.predict(df, models, names, ["g"]).toPandas()["prediction"])
    assert np.allclose(got, np.sort(coef[0] + x @ coef[1:]))


def test_few_groups_do_not_move_the_rows(spark, monkeypatch):

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select(F.when(F.col("id") < 1800, 0).otherwise(F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("value"))
        few = window.zscore(df, "value", ["g"])
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(joins, "SMALL", 1)
        many = window.zscore(df, "value", ["g"])
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_moments_of_many_groups_are_handed_on_early(spark, monkeypatch):

    monkeypatch.setattr(moments, "CELL_BUDGET", 500)
    names = [f"x{k}" for k in range(12)]
    pdf = pd.DataFrame(RNG.normal(size=(400, 12)), columns=names).assign(g=np.arange(400) % 50)
    cells = moments.gram(spark.createDataFrame(pdf), names, ["g"]).toPandas()
    for g, part in cells.groupby("g"):
        x = np.column_stack([np.ones(8), pdf[pdf.g == g][names].to_numpy()])
        assert np.allclose(moments.gram_matrix(part, 13), x.T @ x)


def test_t_tail_is_smooth_across_the_normal_limit():

    for t in (0.5, 2.0, 5.0):
        below, above = student.t_two_sided([t, t], [student.LARGE * 0.999, student.LARGE * 1.001])
        assert np.isclose(below, above, rtol=1e-5)


@pytest.mark.parametrize("on", [["g"], []])
def test_scores_of_points_by_product_and_by_join(spark, monkeypatch, on):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=["y", "a", "b", "c"]).assign(g=np.arange(300) % 3)
    pdf.loc[5, "b"] = np.nan
    models = pd.DataFrame([(g, p, rng.normal(size=4).tolist()) for g in (range(3) if on else [0]) for p in range(5)], columns=["g", "point", "coef"])
    points = spark.createDataFrame(models).withColumn("point", F.col("point").cast("int"))
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    fast = linear.score_points(df, "y", XS, points, on, on).toPandas()
    monkeypatch.setattr(linear, "MODEL_NUMBERS", 0)
    slow = linear.score_points(df, "y", XS, points, on, on).toPandas()
    keys = [*on, "point"]
    both = fast.merge(slow, on=keys)
    assert len(both) == len(fast) == len(slow) == len(models) and np.allclose(both["mae_x"], both["mae_y"])
