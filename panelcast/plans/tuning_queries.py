"""Queries for searches over groups, folds and non-linear families, with check SQL in closed form where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import ordering, resampling, splits, tune
from panelcast.operators.models import grove, linear, tube
from panelcast.plans.model_queries import KEYS, ONE_GRID, SPLIT, split_feat
from panelcast.plans.registry import query
from panelcast.plans.stats_queries import rounded
from panelcast.plans.tables import FEATURES, Tables

#: Candidate thresholds of the check queries.
CUTS = [float(v) for v in range(5, 50, 5)]
CUTS_SQL = ", ".join(f"({v}::DOUBLE)" for v in CUTS)


def clustered(t: Tables):
    """Order lines with scaled predictors, the chronological split and the cluster of their supplier."""
    return split_feat(t).withColumn("cluster", (F.col("l_suppkey") % 8 + 1).cast("int"))


def embedded(t: Tables):
    """Thirty predictors and a target for eight clusters: components of the embeddings."""
    cols = [F.col("vec")[k].alias(f"x{k}") for k in range(30)]
    parts = F.when(F.col("vec_id") % 19 < 13, "train").when(F.col("vec_id") % 19 < 16, "val").otherwise("test")
    return t.emb.select("vec_id", (F.col("vec_id") % 8 + 1).cast("int").alias("cluster"), F.col("vec")[30].alias("y"), parts.alias("split"), *cols)


# ---- T5, T6: trees of every cluster ----


@query("t5_forest_clusters")
def t5_clusters(t: Tables):
    """Eight clusters, mtry 1 to 29: metrics of every point and split."""
    return grove.tree_metrics(embedded(t), "y", [f"x{k}" for k in range(30)], ["cluster"], [{"mtry": m} for m in range(1, 30)], ["vec_id"], bins=16)


@query("t5_forest_refit")
def t5_refit(t: Tables):
    """Best mtry of every cluster of suppliers, refitted on train and val and measured on all splits."""
    _, _, measured = grove.tree_search(clustered(t), "y", FEATURES, ["cluster"], [{"mtry": m} for m in range(1, 5)], KEYS)
    return measured


@query("t6_boosted_clusters")
def t6_clusters(t: Tables):
    """Eight clusters, eight points of step, rows and predictors: metrics of every point and split."""
    grid = linear.param_grid(rounds=[20], depth=[3], eta=[0.3, 0.4], subsample=[0.5, 1.0], colsample=[0.6, 0.8])
    return grove.tree_metrics(clustered(t), "y", FEATURES, ["cluster"], grid, KEYS, "boosted")


STUMP = """{name} AS (SELECT grp, c, GREATEST(nl, 0) AS nl, sl, n, s FROM (SELECT grp, c, COUNT(*) FILTER (quantity <= c) AS nl,
      SUM({y}) FILTER (quantity <= c) AS sl, COUNT(*) AS n, SUM({y}) AS s FROM {src}, (VALUES {cuts}) v(c) GROUP BY grp, c) WHERE nl BETWEEN 1 AND n - 1),
    b{name} AS (SELECT grp, arg_max(c, ROUND(sl * sl / (nl + {l2}) + (s - sl) * (s - sl) / (n - nl + {l2}), 0)) AS c FROM {name} GROUP BY grp),
    v{name} AS (SELECT grp, c, sl / (nl + {l2}) AS lo, (s - sl) / (n - nl + {l2}) AS hi FROM {name} JOIN b{name} USING (grp, c))"""


@query("t5_stump_check", "feat", SPLIT.format(src="feat") + ", tr AS (SELECT * FROM sp WHERE split = 'train'), "
       + STUMP.format(name="a", y="y", src="tr", cuts=CUTS_SQL, l2="0") + " SELECT grp, c AS threshold, ROUND(lo, 4) AS low, ROUND(hi, 4) AS high FROM va")
def t5_stump(t: Tables):
    """A tree of one split on one predictor: the cut that leaves the least squared error, and both means."""
    df = splits.split_by_date(t.feat)
    points = [{"trees": 1, "depth": 1, "min_rows": 1, "bootstrap": False}]
    out = grove.grow(df, "y", ["quantity"], ["grp"], points, KEYS, split="split", edges={"quantity": CUTS})
    return out.select("grp", F.col("threshold")[0].alias("threshold"), F.round(F.col("value")[1], 4).alias("low"), F.round(F.col("value")[2], 4).alias("high"))


@query("t6_two_rounds_check", "feat", SPLIT.format(src="feat") + """, tr AS (SELECT grp, quantity, y, AVG(y) OVER (PARTITION BY grp) AS p0 FROM sp WHERE split = 'train'), r0 AS (SELECT *, y - p0 AS e0 FROM tr), """
       + STUMP.format(name="a", y="e0", src="r0", cuts=CUTS_SQL, l2="1.0::DOUBLE")
       + ", r1 AS (SELECT r0.*, e0 - 0.5::DOUBLE * CASE WHEN quantity <= c THEN lo ELSE hi END AS e1 FROM r0 JOIN va USING (grp)), "
       + STUMP.format(name="z", y="e1", src="r1", cuts=CUTS_SQL, l2="1.0::DOUBLE")
       + """ SELECT r1.grp, COUNT(*) AS n, ROUND(sqrt(AVG(pow(e1 - 0.5::DOUBLE * CASE WHEN quantity <= c THEN lo ELSE hi END, 2))), 4) AS rmse,
      ROUND(AVG(abs(e1 - 0.5::DOUBLE * CASE WHEN quantity <= c THEN lo ELSE hi END)), 4) AS mae FROM r1 JOIN vz USING (grp) GROUP BY r1.grp""")
def t6_two_rounds(t: Tables):
    """Two boosting rounds of single splits on one predictor: errors on the training rows."""
    df = splits.split_by_date(t.feat)
    points = [{"rounds": 2, "depth": 1, "eta": 0.5, "l2": 1.0}]
    held = grove.Held(df, "y", ["quantity"], ["grp"], KEYS, 100, "split")
    models = grove.grow(df, "y", ["quantity"], ["grp"], points, KEYS, "boosted", "split", {"quantity": CUTS}, held=held)
    out = grove.scores(held, models).where("split = 'train'")
    return out.select("grp", "n", F.round(F.sqrt("mse"), 4).alias("rmse"), F.round("mae", 4).alias("mae"))


# ---- U2: folds ----

FOLD_SQL = """, gr AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 0.5::DOUBLE), (2, 2.0::DOUBLE)) v(point, "lambda")),
    tr AS (SELECT grp, fold, COUNT(*) AS n, regr_slope(y, quantity) AS b, AVG(y) AS my, AVG(quantity) AS mx FROM fr WHERE role = 'train' GROUP BY grp, fold),
    er AS (SELECT fr.grp, fr.fold, role, point, "lambda", n, my + b / (1 + "lambda") * (quantity - mx) - y AS e FROM fr JOIN tr USING (grp, fold), gr)
    SELECT grp, CAST(fold AS INTEGER) AS fold, CAST(point AS INTEGER) AS point, "lambda", any_value(n) AS n_train, COUNT(*) FILTER (role = 'test') AS n_test,
      ROUND(sqrt(AVG(e * e) FILTER (role = 'train')), 3) AS rmse_train, ROUND(sqrt(AVG(e * e) FILTER (role = 'test')), 3) AS rmse_test,
      ROUND(AVG(abs(e)) FILTER (role = 'test'), 3) AS mae_test FROM er GROUP BY ALL"""


def _fold_errors(out):
    out = out.select("grp", "fold", "point", "lambda", "n_train", "n_test", F.sqrt("mse_train").alias("rmse_train"), F.sqrt("mse_test").alias("rmse_test"), "mae_test")
    return rounded(out, 3, "rmse_train", "rmse_test", "mae_test")


@query("u2_rolling_origin", "feat", """, ix AS (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS idx FROM (SELECT DISTINCT ts FROM feat)), n AS (SELECT MAX(idx) AS n FROM ix),
    f AS (SELECT i AS fold, 730 + i * 200 AS stop FROM n, range(0, 1 + (n - 730 - 365) // 200) r(i)),
    fr AS (SELECT grp, fold, y, quantity, CASE WHEN idx <= stop THEN 'train' ELSE 'test' END AS role FROM feat JOIN ix USING (ts) JOIN f ON idx > stop - 730 AND idx <= stop + 365)""" + FOLD_SQL)
def u2_rolling(t: Tables):
    """Every group, origin and point: two years of days to fit, one to test, a new origin every 200 days."""
    df = ordering.row_index(t.feat)
    windows = splits.time_slices(ordering.date_index(t.feat), 730, 365, 199)
    return _fold_errors(tune.grid_search(df, "y", ["quantity"], ONE_GRID, ["grp"], folds=windows))


@query("u2_kfold", "feat", """, fr AS (SELECT grp, f.fold, y, quantity, CASE WHEN l_orderkey % 5 = f.fold THEN 'test' ELSE 'train' END AS role FROM feat, range(0, 5) f(fold))""" + FOLD_SQL)
def u2_kfold(t: Tables):
    """Every group, fold and point of a division by order."""
    df = t.feat.withColumn("fold", F.col("l_orderkey") % 5)
    return _fold_errors(tune.grid_search(df, "y", ["quantity"], ONE_GRID, ["grp"], folds="fold"))


@query("u2_rolling_all")
def u2_rolling_all(t: Tables):
    """All predictors, ten lambdas, an origin every thirty days: means over the folds."""
    windows = splits.time_slices(ordering.date_index(t.feat), 730, 90, 29)
    return resampling.over_folds(tune.grid_search(clustered(t), "y", FEATURES, [{"lambda": 10.0**k} for k in range(-6, 4)], ["cluster"], folds=windows), ["cluster"])


@query("u2_repeated_kfold")
def u2_repeated(t: Tables):
    """All predictors, ten lambdas, five folds five times: means over the folds."""
    folds = resampling.KFold(KEYS, 5, 5)
    return resampling.over_folds(tune.grid_search(split_feat(t), "y", FEATURES, [{"lambda": 10.0**k} for k in range(-6, 4)], ["grp"], folds=folds), ["grp"])


@query("u2_bootstrap")
def u2_bootstrap(t: Tables):
    """All predictors, ten lambdas, 25 bootstrap samples tested on the rows they leave out: means over the samples."""
    folds = resampling.Bootstrap(KEYS, 25)
    return resampling.over_folds(tune.grid_search(split_feat(t), "y", FEATURES, [{"lambda": 10.0**k} for k in range(-6, 4)], ["grp"], folds=folds), ["grp"])


@query("u2_samples_check", "feat", """ SELECT f.grp, CAST(fold AS INTEGER) AS fold, COUNT(*) AS n_rows, TRUE AS least FROM feat f, range(0, 10) r(fold) GROUP BY ALL""")
def u2_samples(t: Tables):
    """Repeated folds with several predictors: parts add up to the rows, and no shrinkage fits the training rows best."""
    grid = [{"lambda": v} for v in (0.0, 0.01, 1.0)]
    out = tune.grid_search(t.feat, "y", FEATURES, grid, ["grp"], folds=resampling.KFold(KEYS, 5, 2))
    first = F.min_by("mse_train", "point") <= F.min("mse_train") * (1 + 1e-9)
    return out.groupBy("grp", "fold").agg(F.max(F.col("n_train") + F.col("n_test")).alias("n_rows"), first.alias("least"))


# ---- T7, T9, T10: the epsilon-insensitive loss ----

TUBE_GRID = [{"cost": c, "epsilon": e} for c in (0.01, 1.0) for e in (0.01, 0.1, 0.5)]


def scaled(t: Tables):
    return clustered(t).withColumn("y", F.col("y") / F.lit(1e4))


def _with_point(models, scores, grid):
    """Parameters, objective and errors by split of every group and point."""
    names = list(grid[0])
    values = F.array(*[F.struct(*[F.lit(float(q[n])).alias(n) for n in names]) for q in grid])
    best = models.select("grp", "point", "objective", "bound")
    return scores.join(best, ["grp", "point"]).withColumn("_q", F.get(values, F.col("point"))).select("grp", "point", *[f"_q.{n}" for n in names], "objective", "bound", "split", "n", "mse", "mae")


@query("t7_tube_grid")
def t7_grid(t: Tables):
    """Cost x epsilon for every group: least objective, its lower bound, and errors on every split."""
    return _with_point(*tube.tube_search(scaled(t), "y", FEATURES, ["grp"], TUBE_GRID, KEYS), TUBE_GRID)


@query("t9_radial_grid")
def t9_grid(t: Tables):
    """Sigma x cost on random features of the radial kernel."""
    grid = [{"sigma": s, "cost": c, "epsilon": 0.1} for s in (0.02, 0.1) for c in (0.01, 0.1)]
    return _with_point(*tube.tube_search(scaled(t), "y", FEATURES, ["grp"], grid, KEYS, size=32), grid)


@query("t10_poly_grid")
def t10_grid(t: Tables):
    """Degree x scale x cost on monomials."""
    grid = [{"degree": d, "scale": s, "cost": c, "epsilon": 0.1} for d in (1, 2) for s in (0.1, 0.5) for c in (0.01, 0.1)]
    return _with_point(*tube.tube_search(scaled(t), "y", FEATURES, ["grp"], grid, KEYS), grid)


@query("t7_tube_check", "feat", SPLIT.format(src="feat") + """, v AS (SELECT grp, quantity AS q, COUNT(*) AS m FROM sp WHERE split = 'train' GROUP BY 1, 2),
    gr AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE), (1, 2.5::DOUBLE), (2, 7.0::DOUBLE)) x(point, eps)),
    c AS (SELECT DISTINCT grp, point, eps, q + w * eps AS c FROM v, gr, (VALUES (-1), (1)) s(w)),
    l AS (SELECT c.grp, point, c, SUM(m * GREATEST(abs(q - c) - eps, 0)) AS loss, SUM(m) AS n FROM c JOIN v USING (grp) GROUP BY 1, 2, 3)
    SELECT grp, CAST(point AS INTEGER) AS point, ROUND(MIN(loss) / any_value(n), 1) AS loss FROM l GROUP BY 1, 2""")
def t7_check(t: Tables):
    """Intercept alone: the least mean tube loss lies at a corner of the loss, and SQL tries them all."""
    df = splits.split_by_date(t.feat).withColumn("none", F.lit(0.0))
    grid = [{"cost": 1.0, "epsilon": e} for e in (0.0, 2.5, 7.0)]
    models = tube.tube_fit(df, "quantity", ["none"], ["grp"], grid, KEYS, "split", tol=1e-4)
    n = df.where("split = 'train'").groupBy("grp").agg(F.count("*").alias("n"))
    return models.join(n, "grp").select("grp", "point", F.round(F.col("objective") / F.col("n"), 1).alias("loss"))


@query("u7_tube_refit")
def u7_tube(t: Tables):
    """Best cost and epsilon of every group, refitted on train and val and measured on all splits."""
    df = scaled(t)
    _, tried = tube.tube_search(df, "y", FEATURES, ["grp"], TUBE_GRID, KEYS)
    models, measured = tube.tube_refit(df, "y", FEATURES, ["grp"], TUBE_GRID, KEYS, tried)
    return measured.join(models.select("grp", "point", "objective", "bound"), ["grp", "point"])
