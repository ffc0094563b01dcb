"""Operators whose numbers SQL cannot repeat: their defining properties, measured over whole tables, against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelcast.operators import cluster, correlate, forecast, impute, preprocess, reshape, splits, tune, window
from panelcast.operators.models import kernel, linear, svr, tree
from panelcast.plans.model_queries import HOLES, KEYS, QCOLS, SPLIT, split_feat
from panelcast.plans.registry import query
from panelcast.plans.tables import DAILY, FEATURES, Tables
from panelcast.session import scratch_path
from panelcast.sources.store import Store

ENTITIES = "SELECT entity FROM (SELECT DISTINCT entity FROM cents) JOIN dim USING (entity)"


@query("a5_store_check", "feat", "SELECT grp, COUNT(*) AS n, CAST(0 AS BIGINT) AS changed FROM feat GROUP BY grp")
def a5(t: Tables):
    """Predictions of a model before and after it is stored."""
    model = tree.random_forest(t.feat, "y", FEATURES, 2, trees=3, depth=3)
    store = Store(t.spark, scratch_path(t.spark, "models"), "base")
    store.save_model("forest", model)
    before = model.transform(t.feat).withColumnRenamed("prediction", "before").drop("_features")
    both = store.load_model("forest").transform(before)
    return both.groupBy("grp").agg(F.count("*").alias("n"), F.count_if(F.col("before") != F.col("prediction")).alias("changed"))


@query("o1_impute_check", "holes", f"""SELECT CAST(imp AS INTEGER) AS imp, COUNT(*) AS n, CAST(0 AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS changed,
    CAST(0 AS BIGINT) AS foreign_values FROM holes, range(1, 3) r(imp) GROUP BY imp""")
def o1(t: Tables):
    """No gaps left, observed cells as they were (where the keys name one line), every filled cell an observed value of its column."""
    full = impute.impute_pmm(t.holes, KEYS, HOLES, m=2, maxit=1, donors=5)
    old = t.holes.groupBy(*KEYS).agg(F.count("*").alias("lines"), *[F.first(c).alias(f"old_{c}") for c in HOLES]).where("lines = 1")
    both = full.join(old, KEYS, "left")
    for c in HOLES:
        seen = t.holes.select(F.col(c).cast("double").alias(c), F.lit(True).alias(f"seen_{c}")).where(F.col(c).isNotNull()).distinct()
        both = both.join(seen, c, "left")
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return both.groupBy("imp").agg(
        F.count("*").alias("n"),
        F.sum(sum(one(F.col(c).isNull()) for c in HOLES)).alias("nulls"),
        F.sum(sum(one(F.col(f"old_{c}").isNotNull() & (F.col(f"old_{c}") != F.col(c))) for c in HOLES)).alias("changed"),
        F.sum(sum(one(F.col(f"seen_{c}").isNull()) for c in HOLES)).alias("foreign_values"),
    )


@query("p3_pca_check", "daily", "SELECT CAST(k AS INTEGER) AS component, COUNT(*) AS n, TRUE AS centred, TRUE AS ordered, TRUE AS whole FROM daily, range(0, 6) r(k) GROUP BY k")
def p3(t: Tables):
    """Scores of all components: mean 0, falling variances that add up to the number of columns."""
    pca = preprocess.PCAThreshold.fit(t.daily, DAILY, k=len(DAILY))
    scores = pca.transform(t.daily, ["ts"])
    row = scores.agg(F.count("*"), *[F.avg(c) for c in pca.names], *[F.var_samp(c) for c in pca.names]).first()
    p = len(pca.names)
    mean, var = row[1 : p + 1], row[p + 1 :]
    rows = [(k, row[0], abs(mean[k]) < 1e-9, k == 0 or var[k] <= var[k - 1] + 1e-9, abs(sum(var) - p) < 1e-6) for k in range(p)]
    return t.spark.createDataFrame(rows, "component int, n long, centred boolean, ordered boolean, whole boolean")


@query("q2_kmeans_check", "cents dim", f", e AS ({ENTITIES}) SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS moved, TRUE AS same_wss FROM e")
def q2(t: Tables):
    """Every entity is nearest to the mean of its own cluster, and the sum of squares is that of the labels."""
    df = cluster.cluster_features(t.cents, t.dim)
    labels, wss = cluster.kmeans(df, QCOLS, 3, nstart=5)
    rows = df.join(labels, "entity")
    means = rows.groupBy("cluster").agg(F.array(*[F.avg(c) for c in QCOLS]).alias("m"))
    packed = means.agg(F.collect_list(F.struct("cluster", "m"))).scalar()
    own = F.array(*[F.col(c) for c in QCOLS])
    far = lambda m: F.aggregate(F.zip_with(own, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    scored = rows.withColumn("_means", packed).withColumn("d", F.transform("_means", lambda c: F.struct(far(c["m"]).alias("d"), c["cluster"].alias("c"))))
    mine = F.filter("d", lambda x: x["c"] == F.col("cluster"))[0]["d"]
    return scored.agg(
        F.count("*").alias("n"), F.count_if(mine > F.array_min("d")["d"] + 1e-9).alias("moved"), (F.abs(F.sum(mine) - wss) < 1e-6 * (1 + wss)).alias("same_wss")
    )


@query("q3_elbow_check", "cents dim", f""", e AS ({ENTITIES}), n AS (SELECT COUNT(*) AS n FROM e)
    SELECT CAST(k AS INTEGER) AS k, TRUE AS falls, TRUE AS whole FROM range(1, 6) r(k)""")
def q3(t: Tables):
    """Within sums of squares fall with k; one cluster has the total of the scaled columns."""
    df = cluster.cluster_features(t.cents, t.dim)
    rows = cluster.elbow(df, QCOLS, range(1, 6)).orderBy("k").collect()
    total = df.agg(sum(F.var_samp(c) * (F.count(c) - 1) for c in QCOLS)).first()[0]
    out = [(r["k"], i == 0 or r["wss"] <= rows[i - 1]["wss"] + 1e-9, i > 0 or abs(r["wss"] - total) < 1e-6 * total) for i, r in enumerate(rows)]
    return t.spark.createDataFrame(out, "k int, falls boolean, whole boolean")


@query("q5_gap_check", "dim", "SELECT CAST(k AS INTEGER) AS k, CAST(CASE WHEN k = 1 THEN 3 * (SELECT COUNT(*) - 1 FROM dim) END AS DOUBLE) AS wss, TRUE AS spread FROM range(1, 5) r(k)")
def q5(t: Tables):
    """One cluster of three standardised columns has 3 (n - 1); every k has a positive error."""
    out = cluster.gap_statistic(t.dim, ["lat", "lon", "elev"], range(1, 5), B=10, nstart=2)
    return out.select("k", F.when(F.col("k") == 1, F.round("wss", 4)).alias("wss"), (F.col("s") > 0).alias("spread"))


@query("q6_projection_check", "cents dim clusters", f", e AS ({ENTITIES}) SELECT entity, cluster, TRUE AS known FROM e JOIN clusters USING (entity)")
def q6(t: Tables):
    """Every entity once, with its cluster and two coordinates."""
    out = cluster.cluster_projection(cluster.cluster_features(t.cents, t.dim), QCOLS, t.clusters)
    names = [c for c in out.columns if c not in ("entity", "cluster")]
    return out.select("entity", "cluster", F.forall(F.array(*names), lambda x: x.isNotNull() & ~F.isnan(x)).alias("known"))


@query("s4_kfold_check", "", "SELECT CAST(r AS INTEGER) AS repeat, COUNT(*) AS n, (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) AS keys, CAST(5 AS BIGINT) AS folds FROM lineitem, range(0, 4) x(r) GROUP BY r")
def s4(t: Tables):
    """Each row has one test fold in each repeat."""
    # rows with one key lie together before they are copied, so distinct keys are counted where the copies are
    out = splits.repeated_kfold(t.lineitem.select(*KEYS).repartition(*KEYS), KEYS, 5, 4)
    whole = F.count_if(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEYS]))
    by_key = out.groupBy("repeat", *KEYS).agg(F.count("*").alias("n"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("fold"))).alias("folds"))
    return by_key.groupBy("repeat").agg(F.sum("n").alias("n"), whole.alias("keys"), F.bit_count(F.bit_or("folds")).cast("long").alias("folds"))


@query("s5_bootstrap_check", "", "SELECT CAST(r AS INTEGER) AS replicate, TRUE AS sized, TRUE AS drawn FROM range(0, 25) x(r)")
def s5(t: Tables):
    """Weights add up to about n rows, about 1 - 1/e of the rows are drawn (six deviations)."""
    n = t.lineitem.count()
    out = splits.bootstrap(t.lineitem.select(*KEYS), KEYS, 25).groupBy("replicate").agg(F.sum("weight").alias("w"), F.count("*").alias("m"))
    return out.select("replicate", (F.abs(F.col("w") - n) < 6 * n**0.5).alias("sized"), (F.abs(F.col("m") - n * 0.6321205588) < 3 * n**0.5).alias("drawn"))


@query("s6_random_search_check", "feat", "SELECT grp, CAST(20 AS BIGINT) AS points, TRUE AS inside, TRUE AS fitted FROM (SELECT DISTINCT grp FROM feat)")
def s6(t: Tables):
    """Every drawn point lies in its bounds and beats the variance on the training rows."""
    grid = splits.random_search({"lambda": (1e-4, 10.0), "alpha": (0.0, 1.0)}, 20)
    df = split_feat(t).withColumn("y", F.col("y") / F.lit(1e4))
    var = df.where("split = 'train'").groupBy("grp").agg(F.var_pop("y").alias("v"))
    out = linear.fit_grid(df, "y", FEATURES, grid, ["grp"], "elastic_net").join(var, "grp")
    return out.groupBy("grp").agg(
        F.count_distinct("point").alias("points"), F.every(F.col("lambda").between(1e-4, 10.0) & F.col("alpha").between(0.0, 1.0)).alias("inside"),
        F.every(F.col("mse_train") <= F.col("v") * (1 + 1e-9)).alias("fitted"),
    )


def _beats_variance(t: Tables, kind: str, grid: list):
    df = split_feat(t)
    var = df.where("split = 'train'").agg(F.var_pop("y")).first()[0]
    out = tree.tree_grid(df, "y", FEATURES, grid, kind)
    return out.select(*[F.col(c) for c in grid[0]], (F.col("mse_train") < var).alias("fitted"), (F.col("mse_val") >= 0).alias("measured"))


@query("t5_forest_check", "", "SELECT m AS mtry, 5.0::DOUBLE AS trees, 4.0::DOUBLE AS depth, TRUE AS fitted, TRUE AS measured FROM (VALUES (1.0::DOUBLE), (4.0::DOUBLE)) x(m)")
def t5(t: Tables):
    return _beats_variance(t, "forest", [{"mtry": m, "trees": 5, "depth": 4} for m in (1, 4)])


@query("t6_boosted_check", "", "SELECT 3.0::DOUBLE AS rounds, 3.0::DOUBLE AS depth, e AS eta, TRUE AS fitted, TRUE AS measured FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE)) x(e)")
def t6(t: Tables):
    return _beats_variance(t, "boosted", linear.param_grid(rounds=[3], depth=[3], eta=[0.1, 0.3]))


@query("t7_svr_check", "feat", "SELECT grp, TRUE AS optimal, TRUE AS same_objective FROM (SELECT DISTINCT grp FROM feat)")
def t7(t: Tables):
    """The gradient of the tube loss vanishes at the returned coefficients."""
    df = split_feat(t).withColumn("y", F.col("y") / F.lit(1e4)).where("split = 'train'")
    models = svr.linear_svr(df, "y", FEATURES, ["grp"], cost=1.0, epsilon=0.1)
    rows = linear.predict(df, models, FEATURES, ["grp"]).withColumn("e", F.col("y") - F.col("prediction"))
    out = F.when(F.abs("e") > 0.1, F.col("e") - F.signum("e") * 0.1).otherwise(0.0)
    sums = rows.withColumn("o", out).groupBy("grp").agg(F.sum(F.col("o") * F.col("o")).alias("loss"), F.array(F.sum("o"), *[F.sum(F.col("o") * F.col(x)) for x in FEATURES]).alias("g"), F.sum(F.abs("o")).alias("size"))
    both = sums.join(models, "grp")
    slope = F.zip_with(F.col("coef"), F.col("g"), lambda b, g: b - 2 * g)
    rest = F.aggregate(F.slice(slope, 2, len(FEATURES)), F.lit(0.0), lambda s, v: F.greatest(s, F.abs(v)))
    half = F.aggregate(F.slice("coef", 2, len(FEATURES)), F.lit(0.0), lambda s, v: s + v * v) / 2
    return both.select(
        "grp", (F.greatest(rest, F.abs(2 * F.col("g")[0])) < 1e-3 * (1 + F.col("size"))).alias("optimal"),
        (F.abs(half + F.col("loss") - F.col("objective")) < 1e-6 * (1 + F.col("objective"))).alias("same_objective"),
    )


@query("t9_kernel_check", "feat", SPLIT.format(src="feat") + " SELECT grp, COUNT(*) AS n, TRUE AS solved FROM sp WHERE split = 'train' GROUP BY grp")
def t9(t: Tables):
    """Radial features of one predictor without shrinkage: residuals add up to 0 and are no larger than those of the mean."""
    df = split_feat(t).withColumn("y", F.col("y") / F.lit(1e4)).where("split = 'train'")
    models = kernel.kernel_ridge(df, "y", ["quantity"], 0.1, 1e-6, ["grp"], size=8)
    e = F.col("y") - F.col("prediction")
    out = kernel.kernel_predict(df, models, ["quantity"], 0.1, ["grp"], size=8)
    return out.groupBy("grp").agg(F.count("*").alias("n"), ((F.abs(F.avg(e)) < 1e-6) & (F.avg(e * e) <= F.var_pop("y"))).alias("solved"))


@query("t10_poly_check", "feat", SPLIT.format(src="feat") + """ SELECT grp, ROUND(regr_slope(y / 1e4, quantity), 5) AS slope FROM sp WHERE split = 'train' GROUP BY grp""")
def t10(t: Tables):
    """A polynomial of degree one with next to no shrinkage has the least-squares slope."""
    df = splits.split_by_date(t.feat).withColumn("y", F.col("y") / F.lit(1e4)).where("split = 'train'")
    models = kernel.poly_model(df, "y", ["quantity"], 1, lam=1e-12, by=["grp"])
    return models.select("grp", F.round(F.col("coef")[1], 5).alias("slope"))


@query("n2_pvalue_check", "wide", """, p AS (SELECT corr("click", "view") AS r, COUNT(*) FILTER ("click" IS NOT NULL AND "view" IS NOT NULL) AS n FROM wide),
    q AS (SELECT n, CAST(n - 2 AS DOUBLE) AS d, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM p),
    s AS (SELECT n, SUM((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(t * i / 2000, 2) / d, -(d + 1) / 2)) * t / 2000 / 3
      * exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi()) AS half FROM q, range(0, 2001) x(i) GROUP BY n, d, t)
    SELECT n, ROUND(1 - 2 * half, 6) AS p FROM s""")
def n2(t: Tables):
    """p-value against Simpson's rule over the density."""
    pairs = correlate.with_pvalues(correlate.correlation_pairs(t.wide, ["click", "view"])).where("i < j")
    return pairs.select("n", F.round("p", 6).alias("p"))


@query("u9_fit_log_check", "", "SELECT run, TRUE AS logged FROM (VALUES ('ols'), ('ridge')) x(run)")
def u9(t: Tables):
    """One row for each run, with a start, a duration and an error ratio."""
    df = split_feat(t)
    out = tune.fit_log(t.spark, {
        kind: (lambda kind=kind, p=p: tune.per_entity(df, "y", FEATURES, ["grp"], kind, p)) for kind, p in (("ols", {}), ("ridge", {"lambda": 0.1}))
    })
    return out.select("run", ((F.col("started") > 0) & (F.col("seconds") > 0) & (F.col("mae_ratio") > 0)).alias("logged"))


@query("u2_radial_search", "feat", "SELECT grp, CAST(40 AS BIGINT) AS points, TRUE AS nested, TRUE AS fitted FROM (SELECT DISTINCT grp FROM feat)")
def u2_radial(t: Tables):
    """40 points of the radial family per group: training error grows with the shrinkage and stays below the variance."""
    grid = linear.param_grid(sigma=[0.02, 0.05, 0.1, 0.2, 0.5], **{"lambda": [1e-4, 1e-3, 1e-2, 0.03, 0.1, 0.3, 1.0, 3.0]})
    df = split_feat(t).withColumn("y", F.col("y") / F.lit(1e4))
    var = df.where("split = 'train'").groupBy("grp").agg(F.var_pop("y").alias("v"))
    out = tune.family_search(df, "y", FEATURES, grid, ["grp"], "radial", size=32).join(var, "grp")
    paths = out.groupBy("grp", "sigma", "v").agg(F.array_sort(F.collect_list(F.struct("lambda", "mse_train"))).alias("p"), F.count("*").alias("n"))
    errors = F.transform("p", lambda x: x["mse_train"])
    grows = F.forall(F.zip_with(F.slice(errors, 1, 7), F.slice(errors, 2, 7), lambda a, b: a <= b * (1 + 1e-9)), lambda x: x)
    return paths.groupBy("grp").agg(F.sum("n").alias("points"), F.every(grows).alias("nested"), F.every(F.array_max(errors) <= F.col("v") * (1 + 1e-9)).alias("fitted"))


@query("u2_poly_search", "feat", SPLIT.format(src="feat") + """, m AS (SELECT grp, COUNT(*) AS n, regr_slope(y / 1e4, quantity) AS b, regr_intercept(y / 1e4, quantity) AS a FROM sp WHERE split = 'train' GROUP BY grp)
    SELECT grp, ROUND(AVG(pow(y / 1e4 - a - b * quantity, 2)), 5) AS mse_val FROM sp JOIN m USING (grp) WHERE split = 'val' GROUP BY grp""")
def u2_poly(t: Tables):
    """Validation error of the straight line among the polynomial points."""
    df = splits.split_by_date(t.feat).withColumn("y", F.col("y") / F.lit(1e4))
    grid = linear.param_grid(degree=[1, 2], scale=[0.1, 1.0], **{"lambda": [1e-12, 0.1]})
    out = tune.family_search(df, "y", ["quantity"], grid, ["grp"], "poly")
    return out.where("degree = 1 and scale = 1 and lambda < 1e-6").select("grp", F.round("mse_val", 5).alias("mse_val"))


@query("pipeline_forecast", "cents clusters", """, d AS (SELECT cluster, MAX(ts) AS last FROM cents JOIN clusters USING (entity) GROUP BY cluster)
    SELECT ts, COUNT(*) AS entities, CAST(0 AS BIGINT) AS gaps FROM (SELECT entity, last + CAST(h AS INTEGER) AS ts FROM clusters JOIN d USING (cluster), range(1, 61) x(h)) GROUP BY ts""")
def pipeline_forecast(t: Tables):
    """From the panel to the submission: cluster means, lags, ridge per cluster, recursive forecast, one column per entity."""
    xs = window.lag_names(30, 5)
    mean = cluster.cluster_mean(t.cents, t.clusters).select("cluster", "ts", "value")
    lagged = window.add_lags(mean, 30, 5, entity=["cluster"])
    models = linear.fit(lagged, "value", xs, ["cluster"], "ridge", {"lambda": 0.01})
    future = forecast.future_dates(mean, 60, ["cluster"])
    scored = forecast.forecast_recursive(mean, future, models, (), 30, 5, ["cluster"])
    wide = forecast.submission(scored, t.clusters, reshape.level_order(t.clusters, "entity"))
    rows = reshape.open_entities(wide)
    return rows.groupBy("ts").agg(F.count("*").alias("entities"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("gaps"))
