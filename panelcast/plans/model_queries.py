"""Queries for imputation, preprocessing, clustering, selection, splits, models, tuning and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.scalars import power_grid
from panelcast.operators import cluster, forecast, frame, impute, metrics, ordering, reshape, select, smooth, splits, tune
from panelcast.operators.joins import range_join_folds
from panelcast.operators.models import kernel, linear, svr, tree
from panelcast.operators.preprocess import PCAThreshold, Scaler, pca_distributions, pca_scores_table
from panelcast.plans.core_queries import INDEX
from panelcast.plans.registry import query
from panelcast.plans.stats_queries import rounded
from panelcast.plans.tables import DAILY, EMB_DIM, EVENT_TYPES, FEATURES, Tables
from panelcast.session import scratch_path
from panelcast.sources.store import Store

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)
HOLES = ["price", "quantity", "tax", "discount"]


def split_feat(t: Tables):
    """Order lines with scaled predictors and the chronological split."""
    df = splits.split_by_date(t.feat)
    return Scaler.fit(df.where("split = 'train'"), FEATURES).transform(df)


SPLIT = """, ix AS (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS idx, COUNT(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {src})),
    sp AS (SELECT s.*, idx, CASE WHEN idx <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
      WHEN idx <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
      FROM {src} s JOIN ix USING (ts))"""


# ---- A5 ----


@query("a5_store_model")
def a5(t: Tables):
    store = Store(t.spark, scratch_path(t.spark, "models"), "base")
    store.save_model("forest", tree.random_forest(t.feat, "y", FEATURES, 2, trees=3, depth=3))
    scored = store.load_model("forest").transform(t.feat)
    return metrics.regression_metrics(scored, "y", "prediction", ["grp"])


# ---- O: imputation ----


@query("o1_impute_pmm")
def o1(t: Tables):
    return impute.impute_pmm(t.holes, KEYS, HOLES, m=2, maxit=1, donors=5)


@query("o2_average_imputations", "panel", """, s AS (SELECT entity, ts, value, value * 2 AS other FROM panel
      UNION ALL SELECT entity, ts, value + 10, value * 4 FROM panel)
    SELECT entity, ts, ROUND(AVG(value), 3) AS value, ROUND(AVG(other), 3) AS other FROM s GROUP BY 1, 2""")
def o2(t: Tables):
    a = t.panel.withColumn("other", F.col("value") * 2)
    b = t.panel.select("entity", "ts", (F.col("value") + 10).alias("value"), (F.col("value") * 4).alias("other"))
    return rounded(impute.average_imputations(frame.stack_rows(a, b), ["entity", "ts"], ["value", "other"]), 3, "value", "other")


@query("o3_impute_simple", "holes", f"""SELECT 'mean' AS how, {KEYS_SQL},
      ROUND(coalesce(tax, (SELECT AVG(tax) FROM holes)), 8) AS tax, ROUND(coalesce(discount, (SELECT AVG(discount) FROM holes)), 8) AS discount FROM holes
    UNION ALL SELECT 'median', {KEYS_SQL}, ROUND(coalesce(tax, (SELECT quantile_cont(tax, 0.5) FROM holes)), 8),
      ROUND(coalesce(discount, (SELECT quantile_cont(discount, 0.5) FROM holes)), 8) FROM holes""")
def o3(t: Tables):
    parts = [impute.impute_simple(t.holes, ["tax", "discount"], how).withColumn("how", F.lit(how)) for how in ("mean", "median")]
    return rounded(parts[0].unionByName(parts[1]).drop("price", "quantity"), 8, "tax", "discount")


# ---- P: preprocessing ----


@query("p1_scaler", "feat" , SPLIT.format(src="feat") + f""", m AS (SELECT {", ".join(
      f"AVG({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATURES)} FROM sp WHERE split = 'train')
    SELECT {KEYS_SQL}, split, {", ".join(f"ROUND(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in FEATURES)} FROM sp, m""")
def p1(t: Tables):
    return rounded(split_feat(t).select(*KEYS, "split", *FEATURES), 5, *FEATURES)


@query("p2_pca_explained", "daily", """SELECT 'PC1' AS component, ROUND((1 + abs(corr(d_qty, d_ret))) / 2, 6) AS share FROM daily
    UNION ALL SELECT 'PC2', ROUND((1 - abs(corr(d_qty, d_ret))) / 2, 6) FROM daily""")
def p2(t: Tables):
    pca = PCAThreshold.fit(t.daily, ["d_qty", "d_ret"], 0.9)
    scores = PCAThreshold.fit(t.daily, ["d_qty", "d_ret"], k=2).transform(t.daily, ["ts"])
    var = scores.agg(*[(F.var_samp(c) / 2).alias(c) for c in ("PC1", "PC2")]).unpivot([], ["PC1", "PC2"], "component", "share")
    assert len(pca.names) <= 2
    return rounded(var, 6, "share")


@query("p2_pca_threshold")
def p2b(t: Tables):
    cols = [f"e{k}" for k in range(EMB_DIM)]
    wide = t.emb.select("vec_id", *[F.col("vec")[k].alias(c) for k, c in enumerate(cols)])
    return PCAThreshold.fit(wide, cols, 0.9).transform(wide, ["vec_id"])


@query("p3_pca_scores_table")
def p3(t: Tables):
    pca = PCAThreshold.fit(t.daily, DAILY, 0.9)
    scores = pca_scores_table(t.total.select("ts"), pca, t.daily)
    hist, box = pca_distributions(scores, pca.names)
    return hist.join(box.select("component", "q1", "q2", "q3", "lower", "upper", "outliers"), "component")


# ---- Q: clustering ----

PROFILE = ["mean", "sd", "q25", "q50", "q75", "max", "min", "first"]
QCOLS = [*PROFILE, "last", *[f"{c}_last_year" for c in PROFILE], "lat", "lon", "elev"]


def _prof(src: str, suffix: str) -> str:
    s = suffix
    return f"""SELECT entity, AVG(value) AS mean{s}, stddev_samp(value) AS sd{s}, quantile_cont(value, 0.25) AS q25{s},
      quantile_cont(value, 0.5) AS q50{s}, quantile_cont(value, 0.75) AS q75{s}, MAX(value) AS max{s}, MIN(value) AS min{s},
      arg_min(value, ts) AS first{s}{'' if s else ', arg_max(value, ts) AS last'} FROM {src} GROUP BY entity"""


QCTE = f""", f AS (SELECT * FROM ({_prof('cents', '')}) JOIN ({_prof('(SELECT * FROM cents WHERE year(ts) = (SELECT year(MAX(ts)) FROM cents))', '_last_year')})
      USING (entity) JOIN dim USING (entity))"""


@query("q1_cluster_features", "cents dim", QCTE + f""", m AS (SELECT {", ".join(
      f'AVG("{c}") AS "m_{c}", stddev_samp("{c}") AS "s_{c}"' for c in QCOLS)} FROM f)
    SELECT entity, {", ".join(f'ROUND(("{c}" - "m_{c}") / "s_{c}", 5) AS "{c}"' for c in QCOLS)} FROM f, m""")
def q1(t: Tables):
    return rounded(cluster.cluster_features(t.cents, t.dim), 5, *QCOLS)


@query("q2_kmeans")
def q2(t: Tables):
    labels, _ = cluster.kmeans(cluster.cluster_features(t.cents, t.dim), QCOLS, 8, nstart=25)
    return labels


@query("q3_elbow")
def q3(t: Tables):
    return cluster.elbow(cluster.cluster_features(t.cents, t.dim), QCOLS, range(1, 11))


@query("q4_silhouette", "dim clusters", """, d AS (SELECT entity, cluster, lat, lon FROM dim JOIN clusters USING (entity)),
    p AS (SELECT a.entity, a.cluster, b.cluster AS other, SUM((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS s, COUNT(*) AS n FROM d a, d b GROUP BY 1, 2, 3),
    v AS (SELECT entity, cluster, MAX(CASE WHEN other = cluster THEN s / nullif(n - 1, 0) END) AS a, MIN(CASE WHEN other <> cluster THEN s / n END) AS b FROM p GROUP BY 1, 2)
    SELECT entity, cluster, ROUND(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM v""")
def q4(t: Tables):
    return rounded(cluster.silhouette(t.dim.join(t.clusters, "entity"), ["lat", "lon"]), 6, "silhouette")


@query("q5_gap_statistic")
def q5(t: Tables):
    return cluster.gap_statistic(t.dim, ["lat", "lon", "elev"], range(1, 7), B=20)


@query("q6_cluster_projection")
def q6(t: Tables):
    return cluster.cluster_projection(cluster.cluster_features(t.cents, t.dim), QCOLS, t.clusters)


@query("q7_cluster_mean", "cents clusters daily", """SELECT cluster, ts, AVG(value) AS value, d_qty, d_lines
    FROM cents JOIN clusters USING (entity) JOIN daily USING (ts) GROUP BY cluster, ts, d_qty, d_lines""")
def q7(t: Tables):
    return cluster.cluster_mean(t.cents, t.clusters, t.daily.select("ts", "d_qty", "d_lines"))


@query("q8_cluster_name", "clusters", "SELECT entity, 'Cluster_' || CAST(cluster AS VARCHAR) AS name FROM clusters")
def q8(t: Tables):
    return t.clusters.select("entity", cluster.cluster_name("cluster").alias("name"))


# ---- R: importance ----


@query("r1_importance_linear", "feat", " UNION ALL ".join(
    f"""SELECT grp, '{x}' AS feature, ROUND(abs(corr(y, {x})) * sqrt((COUNT(*) - 2) / (1 - corr(y, {x}) ** 2)), 4) AS score
    FROM feat GROUP BY grp""" for x in FEATURES))
def r1(t: Tables):
    return rounded(select.importance_linear(t.feat, "y", FEATURES, ["grp"]), 4, "score")


def _binned_sql(src: str, key: str, y: str, xs: list[str], edges_from: str, bins: int = 10) -> str:
    parts = []
    for x in xs:
        es = " + ".join(f"CAST({x} > (SELECT quantile_cont({x}, {k / bins}) FROM {edges_from}) AS INTEGER)" for k in range(1, bins))
        distinct = es  # equal edges fall together: they shift the bin number, not the grouping
        parts.append(f"SELECT {key} AS target, '{x}' AS feature, {distinct} AS bin, {y} AS y FROM {src} WHERE {x} IS NOT NULL")
    return f"""c AS (SELECT target, feature, bin, COUNT(*) AS n, SUM(y) AS s, SUM(y * y) AS q FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3),
    sc AS (SELECT target, feature, (SUM(s * s / n) - SUM(s) ** 2 / SUM(n)) / (SUM(q) - SUM(s) ** 2 / SUM(n)) AS score FROM c GROUP BY 1, 2)"""


@query("r2_importance_nonpara", "feat", ", " + _binned_sql("feat", "grp", "y", FEATURES, "feat") + " SELECT target AS grp, feature, ROUND(score, 8) AS score FROM sc")
def r2(t: Tables):
    return rounded(select.importance_nonpara(t.feat, "y", FEATURES, 10, ["grp"]), 8, "score")


@query("r3_importance_all", "panel daily", ", j AS (SELECT * FROM panel JOIN daily USING (ts)), " + _binned_sql("j", "entity", "value", DAILY, "daily") +
       """ SELECT target, feature, ROUND(score, 6) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY target ORDER BY score DESC, feature) AS INTEGER) AS rank FROM sc""")
def r3(t: Tables):
    return rounded(select.importance_all(t.panel, t.daily, DAILY), 6, "score")


# ---- S: splits ----


@query("s1_chrono_split", "total", SPLIT.format(src="total") + " SELECT ts, value, idx, split FROM sp")
def s1(t: Tables):
    return splits.chrono_split(ordering.row_index(t.total)).select("ts", "value", "idx", "split")


@query("s2_holdout_index", "total", INDEX + """, n AS (SELECT COUNT(*) AS n FROM total), b AS (SELECT CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT) AS a,
      CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS v FROM n)
    SELECT role, ts, idx FROM total JOIN ix USING (ts), b, (VALUES ('train'), ('val')) r(role)
    WHERE (role = 'train' AND idx BETWEEN 1 AND a - 150) OR (role = 'val' AND idx BETWEEN a + 1 - 150 AND a + v - 150)""")
def s2(t: Tables):
    indexed = ordering.row_index(t.total)
    return range_join_folds(indexed, splits.holdout_index(indexed, offset=150)).select("role", "ts", "idx")


@query("s3_time_slices", "total", """, n AS (SELECT COUNT(*) AS n FROM total), f AS (SELECT i AS fold, 730 + i * 200 AS stop FROM n, range(0, 1 + (n - 730 - 365) // 200) r(i))
    SELECT CAST(fold AS INTEGER) AS fold, 'train' AS role, CAST(1 AS BIGINT) AS lo, stop AS hi FROM f
    UNION ALL SELECT CAST(fold AS INTEGER), 'test', stop + 1, stop + 365 FROM f""")
def s3(t: Tables):
    return splits.time_slices(ordering.row_index(t.total), 730, 365, 199, fixed=False)


@query("s4_repeated_kfold")
def s4(t: Tables):
    return splits.repeated_kfold(t.lineitem.select(*KEYS), KEYS, 5, 4).groupBy("repeat", "fold").agg(F.count("*").alias("n"))


@query("s5_bootstrap")
def s5(t: Tables):
    out = splits.bootstrap(t.lineitem.select(*KEYS, "l_quantity"), KEYS, 25)
    return out.groupBy("replicate").agg(F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("l_quantity")) / F.sum("weight")).alias("mean"))


@query("s6_random_search")
def s6(t: Tables):
    grid = splits.random_search({"lambda": (1e-4, 10.0), "alpha": (0.0, 1.0)}, 20)
    return linear.fit_grid(split_feat(t), "y", FEATURES, grid, ["grp"], "elastic_net").drop("coef")


# ---- T: models ----


def _coefs(df, xs):
    return df.select("grp", "n", *[F.round(F.col("coef")[k], 4).alias(c) for k, c in enumerate(["intercept", *xs])])


def _one_feature(name: str, kind: str, params: dict, shrink: str):
    """Closed form with one predictor: the slope is the least-squares slope times a shrinkage factor."""

    @query(name, "feat", f""", r AS (SELECT grp, COUNT(*) AS n, regr_slope(y, quantity) AS b, AVG(y) AS my, AVG(quantity) AS mx,
        stddev_pop(quantity) AS sx FROM feat GROUP BY grp), s AS (SELECT *, b * ({shrink}) AS k FROM r)
        SELECT grp, n, ROUND(my - k * mx, 4) AS intercept, ROUND(k, 4) AS quantity FROM s""")
    def fn(t: Tables):
        return _coefs(linear.fit(t.feat, "y", ["quantity"], ["grp"], kind, params), ["quantity"])

    return fn


_one_feature("t1_linear_model_single", "ols", {}, "1")
_one_feature("t2_ridge_single", "ridge", {"lambda": 0.5}, "1 / 1.5::DOUBLE")
_one_feature("t3_elastic_net_single", "elastic_net", {"lambda": 100.0, "alpha": 0.4}, "greatest(abs(b) * sx - 40, 0) / (abs(b) * sx * 61)")
_one_feature("t4_boosted_linear_single", "boost", {"steps": 10, "rate": 0.1}, "1 - 0.9::DOUBLE ** 10")
_one_feature("t8_pls_single", "pls", {"ncomp": 1}, "1")


@query("t1_linear_model")
def t1(t: Tables):
    return _coefs(linear.fit(t.feat, "y", FEATURES, ["grp"]), FEATURES)


@query("t2_ridge_cv")
def t2(t: Tables):
    out = linear.ridge_cv(t.feat, "y", FEATURES, power_grid([-4, -3, -2, -1, 0, 1]), KEYS, ["grp"], shared_lambda="mean")
    return out.select("grp", "n", "lambda", "cv_mae", *[F.col("coef")[k].alias(c) for k, c in enumerate(["intercept", *FEATURES])])


@query("t3_elastic_net")
def t3(t: Tables):
    grid = linear.param_grid(alpha=[k / 9 for k in range(10)], **{"lambda": power_grid([-3, -2.5, -2, -1.5, -1, -0.5, 0, 0.5, 1, 1.5])})
    return linear.fit_grid(split_feat(t), "y", FEATURES, grid, ["grp"], "elastic_net").drop("coef")


@query("t4_boosted_linear")
def t4(t: Tables):
    grid = linear.param_grid(steps=[10, 50, 200], rate=[0.05, 0.1])
    return linear.fit_grid(split_feat(t), "y", FEATURES, grid, ["grp"], "boost").drop("coef")


@query("t5_random_forest")
def t5(t: Tables):
    return tree.tree_grid(split_feat(t), "y", FEATURES, [{"mtry": m, "trees": 10, "depth": 5} for m in (1, 2, 4)])


@query("t6_boosted_trees")
def t6(t: Tables):
    grid = linear.param_grid(rounds=[5], depth=[3], eta=[0.1, 0.3], subsample=[0.8], colsample=[0.8])
    return tree.tree_grid(split_feat(t), "y", FEATURES, grid, "boosted")


@query("t7_linear_svr")
def t7(t: Tables):
    df = split_feat(t).withColumn("y", F.col("y") / F.lit(1e4))
    models = svr.linear_svr(df.where("split = 'train'"), "y", FEATURES, ["grp"], cost=1.0, epsilon=0.1)
    return models.select("grp", "objective", *[F.col("coef")[k].alias(c) for k, c in enumerate(["intercept", *FEATURES])])


@query("t8_pls")
def t8(t: Tables):
    return linear.fit_grid(split_feat(t), "y", FEATURES, [{"ncomp": k} for k in range(1, 6)], ["grp"], "pls").drop("coef")


@query("t9_kernel_ridge_rff")
def t9(t: Tables):
    df = split_feat(t)
    models = kernel.kernel_ridge(df.where("split = 'train'"), "y", FEATURES, 0.1, 1e-3, ["grp"])
    return metrics.regression_metrics(kernel.kernel_predict(df, models, FEATURES, 0.1, ["grp"]), "y", by=["grp", "split"])


@query("t10_poly_model")
def t10(t: Tables):
    df = split_feat(t)
    models = kernel.poly_model(df.where("split = 'train'"), "y", FEATURES, 2, by=["grp"])
    return metrics.regression_metrics(kernel.poly_predict(df, models, FEATURES, 2, by=["grp"]), "y", by=["grp", "split"])


@query("t11_predict", "feat", f""", r AS (SELECT grp, regr_slope(y, retailprice) AS b, regr_intercept(y, retailprice) AS a FROM feat GROUP BY grp)
    SELECT grp, {KEYS_SQL}, ROUND(a + b * retailprice, 3) AS prediction FROM feat JOIN r USING (grp)""")
def t11(t: Tables):
    models = linear.fit(t.feat, "y", ["retailprice"], ["grp"])
    return rounded(linear.predict(t.feat, models, ["retailprice"], ["grp"]).select("grp", *KEYS, "prediction"), 3, "prediction")


# ---- U: tuning and evaluation ----


@query("u1_param_grid", "panel", """SELECT entity, cost, gamma, COUNT(*) AS n FROM panel, (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) a(cost),
    (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) b(gamma) GROUP BY 1, 2, 3""")
def u1(t: Tables):
    grid = linear.param_grid(cost=[1.0, 10.0, 100.0], gamma=[0.1, 0.2])
    points = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in p.items()]) for p in grid])
    return t.panel.groupBy("entity").agg(F.count("*").alias("n")).select("entity", "n", F.inline(points))


@query("u2_grid_search")
def u2(t: Tables):
    return tune.grid_search(split_feat(t), "y", FEATURES, [{"lambda": v} for v in power_grid([-3, -2, -1, 0])], ["grp"]).drop("coef")


PRED = SPLIT.format(src="panel") + ", pr AS (SELECT *, value * 0.9::DOUBLE + 10 AS prediction FROM sp)"
SPLIT_MEANS = ", ".join(
    f"AVG({e}) FILTER ({c}) AS {m}_{n}"
    for m, e in (("mse", "(prediction - value) ** 2"), ("mae", "abs(prediction - value)"))
    for n, c in (("train", "split = 'train'"), ("val", "split = 'val'"), ("train_val", "split IN ('train', 'val')"), ("test", "split = 'test'")))
MET = PRED + f", me AS (SELECT entity, {SPLIT_MEANS} FROM pr GROUP BY entity), di AS (SELECT *, mae_test / nullif(mae_train_val, 0) AS mae_ratio FROM me)"
LABEL = "CASE WHEN mae_ratio < 1 THEN 'Underfitting' WHEN mae_ratio = 0 THEN 'Fit' WHEN mae_ratio IS NOT NULL THEN 'Overfitting' END"


def predicted(t: Tables):
    df = splits.split_by_date(t.panel)
    return df.withColumn("prediction", F.col("value") * F.lit(0.9) + 10)


@query("u3_regression_metrics", "panel", PRED + """ SELECT entity, split, COUNT(*) AS n, ROUND(AVG((prediction - value) ** 2), 1) AS mse,
    ROUND(sqrt(AVG((prediction - value) ** 2)), 4) AS rmse, ROUND(AVG(abs(prediction - value)), 5) AS mae FROM pr GROUP BY 1, 2""")
def u3(t: Tables):
    out = metrics.regression_metrics(predicted(t))
    return out.withColumns({"mse": F.round("mse", 1), "rmse": F.round("rmse", 4), "mae": F.round("mae", 5)})


@query("u4_fit_diagnosis", "panel", MET + f" SELECT entity, ROUND(mae_test, 5) AS mae_test, ROUND(mae_train_val, 5) AS mae_train_val, ROUND(mae_ratio, 7) AS mae_ratio, {LABEL} AS fitting FROM di")
def u4(t: Tables):
    out = metrics.fit_diagnosis(metrics.split_metrics(predicted(t)))
    return rounded(rounded(out.select("entity", "mae_test", "mae_train_val", "mae_ratio", "fitting"), 5, "mae_test", "mae_train_val"), 7, "mae_ratio")


@query("u5_collect_results", "panel", MET + f""", l AS (SELECT ROUND(mae_ratio, 7) AS mae_ratio, {LABEL} AS fitting FROM di),
    g AS (SELECT MIN(mae_ratio) AS lo, (MAX(mae_ratio) - MIN(mae_ratio)) / 10 AS w FROM l),
    b AS (SELECT fitting, CAST(least(9, floor((mae_ratio - lo) / w)) AS INTEGER) AS bin, lo, w FROM l, g),
    c AS (SELECT fitting, bin, lo, w, COUNT(*) AS count FROM b GROUP BY 1, 2, 3, 4)
    SELECT fitting, bin, ROUND(lo + bin * w, 6) AS "left", count, ROUND(count / (SUM(count) OVER (PARTITION BY fitting) * w), 5) AS density FROM c""")
def u5(t: Tables):
    out = metrics.collect_results(rounded(metrics.fit_diagnosis(metrics.split_metrics(predicted(t))), 7, "mae_ratio"))
    return rounded(rounded(out, 6, "left"), 5, "density")


@query("u6_predicted_vs_actual", "panel", "SELECT entity, ts, ROUND(value * 0.9::DOUBLE + 10, 4) AS prediction, value AS actual FROM panel")
def u6(t: Tables):
    return rounded(metrics.predicted_vs_actual(predicted(t)), 4, "prediction")


@query("u7_refit_best")
def u7(t: Tables):
    df, grid = split_feat(t), [{"lambda": v} for v in power_grid([-3, -2, -1, 0])]
    results = linear.fit_grid(df, "y", FEATURES, grid, ["grp"])
    return tune.refit_best(df, "y", FEATURES, results, grid, ["grp"])


@query("u8_per_entity")
def u8(t: Tables):
    return tune.per_entity(split_feat(t), "y", FEATURES, ["l_suppkey"])


ONE_FEATURE = SPLIT.format(src="feat") + """, gr AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.5::DOUBLE), (2, 2.0::DOUBLE)) v(point, "lambda")),
    tr AS (SELECT {key}, point, "lambda", regr_slope(y, quantity) / (1 + "lambda") AS b, AVG(y) AS my, AVG(quantity) AS mx
      FROM sp, gr WHERE split IN ({fit}) GROUP BY {key}, point, "lambda"),
    pr AS (SELECT {key}, sp.split, point, "lambda", my + b * (quantity - mx) - y AS e FROM sp JOIN tr USING ({key}))"""
ONE_GRID = [{"lambda": v} for v in (0.0, 0.5, 2.0)]


@query("u2_grid_search_single", "feat", ONE_FEATURE.format(key="grp", fit="'train'") + """ SELECT grp, CAST(point AS INTEGER) AS point, "lambda",
    ROUND(sqrt(AVG(e * e) FILTER (split = 'train')), 4) AS mse_train, ROUND(sqrt(AVG(e * e) FILTER (split = 'val')), 4) AS mse_val,
    ROUND(AVG(abs(e)) FILTER (split = 'train'), 4) AS mae_train, ROUND(AVG(abs(e)) FILTER (split = 'val'), 4) AS mae_val FROM pr GROUP BY ALL""")
def u2b(t: Tables):
    out = tune.grid_search(splits.split_by_date(t.feat), "y", ["quantity"], ONE_GRID, ["grp"]).drop("coef")
    out = out.withColumns({c: F.sqrt(c) for c in ("mse_train", "mse_val")})
    return rounded(out, 4, "mse_train", "mse_val", "mae_train", "mae_val")


@query("u7_refit_best_single", "feat", ONE_FEATURE.format(key="grp", fit="'train'") + """, w AS (SELECT grp, arg_min(point, m) AS point FROM
      (SELECT grp, point, AVG(e * e) AS m FROM pr WHERE split = 'val' GROUP BY 1, 2) GROUP BY grp),
    t2 AS (SELECT grp, point, regr_slope(y, quantity) / (1 + "lambda") AS b, AVG(y) AS my, AVG(quantity) AS mx FROM sp JOIN w USING (grp) JOIN gr USING (point)
      WHERE split <> 'test' GROUP BY grp, point, "lambda"),
    e2 AS (SELECT grp, point, split, my + b * (quantity - mx) - y AS e FROM sp JOIN t2 USING (grp))
    SELECT grp, CAST(point AS INTEGER) AS point, ROUND(AVG(abs(e)) FILTER (split <> 'test'), 4) AS mae_train_val,
      ROUND(AVG(abs(e)) FILTER (split = 'test'), 4) AS mae_test FROM e2 GROUP BY 1, 2""")
def u7b(t: Tables):
    df = splits.split_by_date(t.feat)
    results = linear.fit_grid(df, "y", ["quantity"], ONE_GRID, ["grp"])
    out = tune.refit_best(df, "y", ["quantity"], results, ONE_GRID, ["grp"])
    return rounded(out.select("grp", "point", "mae_train_val", "mae_test"), 4, "mae_train_val", "mae_test")


@query("u8_per_entity_single", "feat", SPLIT.format(src="feat") + """, tr AS (SELECT l_suppkey, regr_slope(y, quantity) AS b, regr_intercept(y, quantity) AS a
      FROM sp WHERE split = 'train' GROUP BY 1), pr AS (SELECT l_suppkey, split, a + b * quantity - y AS e FROM sp JOIN tr USING (l_suppkey))
    SELECT l_suppkey, ROUND(AVG(abs(e)) FILTER (split = 'train'), 4) AS mae_train, ROUND(AVG(abs(e)) FILTER (split = 'test'), 4) AS mae_test,
      ROUND(AVG(abs(e)) FILTER (split = 'test') / AVG(abs(e)) FILTER (split = 'train'), 7) AS mae_ratio FROM pr GROUP BY 1""")
def u8b(t: Tables):
    out = tune.per_entity(splits.split_by_date(t.feat), "y", ["quantity"], ["l_suppkey"])
    return rounded(rounded(out.select("l_suppkey", "mae_train", "mae_test", "mae_ratio"), 4, "mae_train", "mae_test"), 7, "mae_ratio")


@query("u9_fit_log")
def u9(t: Tables):
    df = split_feat(t)
    return tune.fit_log(t.spark, {
        kind: (lambda kind=kind, p=p: tune.per_entity(df, "y", FEATURES, ["l_suppkey"], kind, p))
        for kind, p in (("ols", {}), ("ridge", {"lambda": 0.1}))})


# ---- L4: smooth trend ----


@query("l4_smooth_trend")
def l4(t: Tables):
    return smooth.smooth_trend(t.panel)


@query("l4_binned_trend", "cents", """SELECT entity, CAST(floor(date_diff('day', DATE '1970-01-01', ts) / 30) AS INTEGER) AS bin,
    AVG(value) AS smooth, COUNT(*) AS n FROM cents GROUP BY 1, 2""")
def l4b(t: Tables):
    return smooth.binned_trend(t.cents)


# ---- W: forecasts ----


@query("w1_forecast_direct", "ev", """, r AS (SELECT entity, regr_slope(value, CAST(date_diff('day', DATE '2024-01-01', ts) AS DOUBLE)) AS b,
      regr_intercept(value, CAST(date_diff('day', DATE '2024-01-01', ts) AS DOUBLE)) AS a, MAX(ts) AS last FROM ev GROUP BY entity),
    p AS (SELECT entity, last + CAST(h AS INTEGER) AS ts, a + b * date_diff('day', DATE '2024-01-01', last + CAST(h AS INTEGER)) AS v FROM r, range(1, 15) x(h))
    SELECT ts, """ + ", ".join(f"""ROUND(MAX(CASE WHEN entity = '{e}' THEN v END), 4) AS "{e}\"""" for e in EVENT_TYPES) + " FROM p GROUP BY ts")
def w1(t: Tables):
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("double")
    models = linear.fit(t.ev.withColumn("day", day), "value", ["day"], ["entity"])
    new = forecast.future_dates(t.ev, 14, ["entity"]).withColumn("day", day)
    return rounded(forecast.forecast_direct(models, new, ["day"], EVENT_TYPES), 4, *EVENT_TYPES)


@query("w2_forecast_recursive", "dense", """, h AS (SELECT entity, ts, value, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ts) AS idx,
      COUNT(*) OVER (PARTITION BY entity) AS n, MAX(ts) OVER (PARTITION BY entity) AS last FROM dense),
    a AS (SELECT x.entity, x.last, k, 1000 + 0.5::DOUBLE * p.value + 0.3::DOUBLE * q.value AS v FROM (SELECT DISTINCT entity, last, n FROM h) x, range(1, 31) r(k),
      h p, h q WHERE p.entity = x.entity AND q.entity = x.entity AND p.idx = x.n + k - 30 AND q.idx = x.n + k - 60),
    b AS (SELECT a.entity, a.last, a.k + 30 AS k, 1000 + 0.5::DOUBLE * a.v + 0.3::DOUBLE * h.value AS v FROM a JOIN h ON h.entity = a.entity AND h.idx = h.n + a.k - 30)
    SELECT entity, last + CAST(k AS INTEGER) AS ts, ROUND(v, 2) AS prediction FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def w2(t: Tables):
    rule = t.dense.select("entity").distinct().withColumn("coef", F.array(F.lit(1000.0), F.lit(0.5), F.lit(0.3)))
    new = forecast.future_dates(t.dense, 60, ["entity"])
    return rounded(forecast.forecast_recursive(t.dense, new, rule, (), 30, 2, ["entity"]), 2, "prediction")


@query("w2_forecast_fitted")
def w2b(t: Tables):
    from panelcast.operators.window import add_lags, lag_names

    xs = lag_names(30, 5)
    lagged = add_lags(t.dense, 30, 5)
    models = linear.fit(lagged, "value", xs, ["entity"], "ridge", {"lambda": 0.01})
    return forecast.forecast_recursive(t.dense, forecast.future_dates(t.dense, 365, ["entity"]), models, (), 30, 5, ["entity"])


@query("w3_submission", "cents clusters", """, m AS (SELECT cluster, ts, ROUND(AVG(value)) AS v FROM cents JOIN clusters USING (entity) GROUP BY 1, 2)
    SELECT ts, entity, v AS value FROM m JOIN clusters USING (cluster) WHERE ts >= DATE '2001-01-01'""")
def w3(t: Tables):
    """One column per entity in the submission; opened again to compare all of them."""
    mean = cluster.cluster_mean(t.cents, t.clusters).select("cluster", "ts", F.round("value").alias("prediction"))
    return reshape.open_entities(forecast.submission(mean, t.clusters, reshape.level_order(t.clusters, "entity"), "2001-01-01"))
