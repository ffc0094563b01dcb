"""Queries for quality profile, distributions, series and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import correlate, moments, profile, rank, series
from panelcast.operators import distribution as dist
from panelcast.plans.registry import query
from panelcast.plans.tables import DAILY, EMB_DIM, FEATURES, Tables

HOLES = ["price", "quantity", "tax", "discount"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits: int, *cols: str):
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---- K: data quality ----


@query("k1_null_report", "holes", """, c AS (SELECT COUNT(*) FILTER (tax IS NULL) + COUNT(*) FILTER (discount IS NULL) AS count,
      COUNT(*) * 8 AS cells FROM holes)
    SELECT count, round_even(count / cells::DOUBLE * 100, 1) AS number,
      'There are ' || printf('%.1f', round_even(count / cells::DOUBLE * 100, 1)) || '% nulls in ''holes''' AS text FROM c
    UNION ALL SELECT 0, 0.0, 'No nulls in ''lineitem'''""")
def k1(t: Tables):
    return profile.null_report(t.holes, "holes").union(profile.null_report(t.lineitem, "lineitem"))


@query("k2_constant_columns", sql="""SELECT 1 AS criteria, v AS variable FROM (VALUES ('one'), ('empty')) x(v)
    WHERE (SELECT COUNT(*) FROM lineitem) > 0
    UNION ALL SELECT 2, 'l_linestatus' WHERE (SELECT COUNT(DISTINCT l_linestatus) FROM lineitem) = 2
    UNION ALL SELECT 2, 'l_returnflag' WHERE (SELECT COUNT(DISTINCT l_returnflag) FROM lineitem) = 2""")
def k2(t: Tables):
    df = t.lineitem.withColumn("one", F.lit(1)).withColumn("empty", F.lit(None).cast("double"))
    cols = ["l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "one", "empty"]
    one = profile.constant_columns(df, cols, 1).select(F.lit(1).alias("criteria"), "variable")
    return one.union(profile.constant_columns(df, cols[:4], 2).select(F.lit(2).alias("criteria"), "variable"))


Z = ", z AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, l_orderkey, l_linenumber, l_partkey, l_suppkey, {c} AS value,
      ({c} - (SELECT AVG({c}) FROM holes)) / (SELECT stddev_samp({c}) FROM holes) AS z FROM holes WHERE {c} IS NOT NULL"""
    for c in HOLES) + ")"


@query("k3_outlier_scores", "holes", Z + " SELECT variable, l_orderkey, l_linenumber, l_partkey, l_suppkey, value, ROUND(z, 5) AS z FROM z")
def k3(t: Tables):
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rounded(profile.outlier_scores(t.holes, HOLES, ids), 5, "z")


@query("k4_outlier_table", "panel", """, z AS (SELECT (value - AVG(value) OVER (PARTITION BY entity)) /
      stddev_samp(value) OVER (PARTITION BY entity) AS z FROM panel) SELECT abs(z) >= 3 AS outlier, COUNT(*) AS n FROM z GROUP BY 1""")
def k4(t: Tables):
    from panelcast.operators.window import zscore

    return profile.outlier_table(zscore(t.panel, "value", ["entity"]), 3.0)


@query("k5_skim_numeric", "holes", " UNION ALL ".join(f"""SELECT '{c}' AS variable, COUNT(*) AS n,
    COUNT(*) - COUNT({c}) AS missing, ROUND(COUNT({c}) / COUNT(*)::DOUBLE, 6) AS complete_rate, ROUND(AVG({c}), 6) AS mean,
    ROUND(stddev_samp({c}), 6) AS sd, MIN({c}) AS p0, ROUND(quantile_cont({c}, 0.25), 6) AS p25,
    ROUND(quantile_cont({c}, 0.5), 6) AS p50, ROUND(quantile_cont({c}, 0.75), 6) AS p75, MAX({c}) AS p100 FROM holes""" for c in HOLES))
def k5(t: Tables):
    return rounded(profile.skim_numeric(t.holes, HOLES), 6, "complete_rate", "mean", "sd", "p25", "p50", "p75")


@query("k5_skim_text", sql=" UNION ALL ".join(f"""SELECT '{c}' AS variable, COUNT(*) AS n, COUNT(*) - COUNT({c}) AS missing,
    CAST(MIN(length({c})) AS INTEGER) AS min_length, CAST(MAX(length({c})) AS INTEGER) AS max_length,
    COUNT(*) FILTER ({c} = '') AS empty, COUNT(DISTINCT {c}) AS n_unique FROM part""" for c in ("p_name", "p_brand", "p_type")))
def k5b(t: Tables):
    part = t.table("part")
    return profile.skim_text(part, profile.split_by_type(part)["text"])


@query("k5_skim_date", "panel", """SELECT 'ts' AS variable, COUNT(*) AS n, COUNT(*) - COUNT(ts) AS missing, MIN(ts) AS min,
    MAX(ts) AS max, COUNT(DISTINCT ts) AS n_unique FROM panel""")
def k5c(t: Tables):
    return profile.skim_date(t.panel, ["ts"])


@query("k6_glimpse", sql="WITH h AS (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5) " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{ty}' AS type, string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY s_suppkey) AS values FROM h"
    for c, ty in (("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"))))
def k6(t: Tables):
    return profile.glimpse(t.table("supplier"), 5, ["s_suppkey"])


# ---- L: distributions ----


@query("l1_histogram", "panel", """, r AS (SELECT MIN(value) AS lo, (MAX(value) - MIN(value)) / 30 AS w FROM panel),
    b AS (SELECT entity, CAST(least(29, floor((value - lo) / w)) AS INTEGER) AS bin, lo, w FROM panel, r),
    c AS (SELECT 'each' AS facet, entity, bin, lo, w, COUNT(*) AS count FROM b GROUP BY 2, 3, 4, 5
          UNION ALL SELECT 'all', NULL, bin, lo, w, COUNT(*) FROM b GROUP BY 3, 4, 5)
    SELECT facet, entity, bin, ROUND(lo + bin * w, 6) AS "left", count,
      ROUND(count / (SUM(count) OVER (PARTITION BY facet, entity) * w) * 1e6, 6) AS density FROM c""")
def l1(t: Tables):
    whole = dist.histogram(t.panel, "value", 30).withColumn("facet", F.lit("all"))
    each = dist.histogram(t.panel, "value", 30, ["entity"]).withColumn("facet", F.lit("each"))
    out = each.unionByName(whole, allowMissingColumns=True)
    return out.withColumns({"left": F.round("left", 6), "density": F.round(F.col("density") * F.lit(1e6), 6)})


@query("l1_histogram_sturges", "cents", """, r AS (SELECT entity, MIN(value) AS lo, MAX(value) AS hi,
      CAST(ceil(log2(COUNT(*))) + 1 AS INTEGER) AS k, COUNT(*) AS n FROM cents GROUP BY entity)
    SELECT entity, CAST(least(k - 1, floor((value - lo) / ((hi - lo) / k))) AS INTEGER) AS bin, COUNT(*) AS count
    FROM cents JOIN r USING (entity) GROUP BY ALL""")
def l1b(t: Tables):
    return dist.histogram(t.cents, "value", None, ["entity"], group_range=True).select("entity", "bin", "count")


@query("l2_kde", "cents", """, d AS (SELECT CAST(year(ts) AS INTEGER) AS year, value AS x FROM cents),
    m AS (SELECT year, COUNT(*) AS n, stddev_samp(x) AS sd, MIN(x) AS lo, MAX(x) AS hi,
      (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34::DOUBLE AS iqr FROM d GROUP BY 1),
    p AS (SELECT year, n, lo, 0.9::DOUBLE * least(sd, iqr) * n::DOUBLE ** -0.2::DOUBLE AS bw, (hi - lo) / 511 AS s FROM m),
    c AS (SELECT year, n, lo, bw, s, least(511, floor((x - lo) / s + 0.5::DOUBLE)) AS b, COUNT(*) AS cnt FROM d JOIN p USING (year) GROUP BY ALL)
    SELECT year, CAST(g AS INTEGER) AS point, ROUND(lo + g * s, 4) AS x,
      ROUND(SUM(cnt * exp(-0.5::DOUBLE * ((g - b) * s / bw) ** 2)) / (n * bw * sqrt(2 * pi())) * 1e6, 7) AS density
    FROM c, range(0, 512) r(g) GROUP BY year, n, lo, bw, s, g""")
def l2(t: Tables):
    out = dist.kde(t.cents.withColumn("year", F.year("ts")), "value", 512, ["year"])
    return out.withColumns({"x": F.round("x", 4), "density": F.round(F.col("density") * F.lit(1e6), 7)})


def _box_sql(keys: str, src: str = "d") -> str:
    return f""", q AS (SELECT {keys}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM {src} GROUP BY ALL),
    f AS (SELECT *, x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM {src} JOIN q USING ({keys}))
    SELECT {keys}, q1, q2, q3, MIN(x) FILTER (inside) AS lower, MAX(x) FILTER (inside) AS upper, COUNT(*) FILTER (NOT inside) AS outliers,
      COUNT(*) AS n FROM f GROUP BY {keys}, q1, q2, q3"""


@query("l3_boxplot_stats", "cents", ", d AS (SELECT entity, value AS x FROM cents)" + _box_sql("entity"))
def l3(t: Tables):
    return dist.boxplot_stats(t.cents, "value", ["entity"])


@query("l3_boxplot_outliers", "cents", """, q AS (SELECT entity, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM cents GROUP BY 1)
    SELECT entity, ts, value FROM cents JOIN q USING (entity) WHERE NOT value BETWEEN a - 1.5::DOUBLE * (b - a) AND b + 1.5::DOUBLE * (b - a)""")
def l3b(t: Tables):
    return dist.boxplot_outliers(t.cents, "value", ["entity"])


@query("l5_weighted_grid", "cents dim", """, m AS (SELECT entity, SUM(value) AS value FROM cents GROUP BY entity)
    SELECT CAST(floor(lon / 0.5::DOUBLE) AS BIGINT) AS cx, CAST(floor(lat / 0.5::DOUBLE) AS BIGINT) AS cy, SUM(value) AS weight,
      COUNT(*) AS n FROM m JOIN dim USING (entity) GROUP BY 1, 2""")
def l5(t: Tables):
    pts = t.cents.groupBy("entity").agg(F.sum("value").alias("value")).join(t.dim, "entity")
    return dist.weighted_grid(pts, 0.5)


def _l6(name: str, period: str, expr: str, by: list[str]):
    keys = ", ".join([*by, period])
    d = f", d AS (SELECT {', '.join([*by, f'CAST({expr} AS INTEGER) AS {period}'])}, value AS x FROM cents)"

    @query(name, "cents", d + _box_sql(keys))
    def fn(t: Tables):
        return dist.period_distribution(t.cents, period, by)

    return fn


_l6("l6_by_year", "year", "year(ts)", [])
_l6("l6_by_month", "month", "month(ts)", [])
_l6("l6_by_day_of_week", "day_of_week_monday", "isodow(ts)", [])
_l6("l6_by_entity_month", "month", "month(ts)", ["entity"])


# ---- M: series ----


def _decompose_sql(src: str, period: int) -> str:
    h = period // 2
    total = "SUM(value) OVER w"
    if period % 2 == 0:
        total = f"({total} - (LAG(value, {h}) OVER o + LEAD(value, {h}) OVER o) / 2)"
    return f""", tr AS (SELECT entity, ts, value, ROW_NUMBER() OVER o AS idx,
      CASE WHEN COUNT(value) OVER w = {2 * h + 1} THEN {total} / {period} END AS trend FROM {src}
      WINDOW o AS (PARTITION BY entity ORDER BY ts), w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)),
    ph AS (SELECT *, CAST((idx - 1) % {period} AS INTEGER) AS phase FROM tr),
    fi AS (SELECT entity, phase, AVG(value - trend) AS s FROM ph GROUP BY 1, 2),
    lv AS (SELECT entity, AVG(s) AS m FROM fi GROUP BY 1)
    SELECT entity, ts, value, idx, phase, ROUND(trend, 2) AS trend, ROUND(s - m, 2) AS seasonal, ROUND(value - trend - (s - m), 2) AS random
    FROM ph JOIN fi USING (entity, phase) JOIN lv USING (entity)"""


@query("m1_decompose", "dense", _decompose_sql("dense", 365))
def m1(t: Tables):
    return rounded(series.decompose(t.dense, 365), 2, "trend", "seasonal", "random")


@query("m1_decompose_weekly", "ev", ", evc AS (SELECT entity, ts, ROUND(value * 100) AS value FROM ev)" + _decompose_sql("evc", 7))
def m1b(t: Tables):
    return rounded(series.decompose(t.ev.withColumn("value", F.round(F.col("value") * 100)), 7), 2, "trend", "seasonal", "random")


@query("m1_decompose_mean", "cents", ", ms AS (SELECT 'all' AS entity, ts, AVG(value) AS value FROM cents GROUP BY ts)" + _decompose_sql("ms", 365))
def m1c(t: Tables):
    return rounded(series.decompose(series.panel_mean_series(t.cents), 365), 2, "trend", "seasonal", "random")


@query("m2_trend_of", "cents", """, s AS (SELECT entity, SUM(value) AS total FROM cents GROUP BY 1 ORDER BY total DESC, entity LIMIT 5)
    SELECT entity, ts, CASE WHEN COUNT(value) OVER w = 365 THEN SUM(value) OVER w / 365 END AS trend FROM cents
    WHERE entity IN (SELECT entity FROM s) WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING)""")
def m2(t: Tables):
    return series.trend_of(t.cents, rank.top_k(t.cents, 5).select("entity"), 365)


@query("m3_panel_mean_series", "cents", "SELECT 'all' AS entity, ts, AVG(value) AS value FROM cents GROUP BY ts")
def m3(t: Tables):
    return series.panel_mean_series(t.cents)


# ---- N: moments and correlation ----

N0_COLS = ["y", *FEATURES]


def _gram_sql(cols: list[str], src: str, by: str = "grp") -> str:
    aug = ["1", *cols]
    return " UNION ALL ".join(
        f"SELECT {by}, {i} AS i, {j} AS j, ROUND(SUM(({aug[i]}) * ({aug[j]})) / COUNT(*), 3) AS s FROM {src} GROUP BY {by}"
        for i in range(len(aug)) for j in range(i, len(aug)))


@query("n0_gram", "feat", _gram_sql(N0_COLS, "feat"))
def n0(t: Tables):
    cells = moments.gram(t.feat, N0_COLS, ["grp"])
    n = cells.where("i = 0 AND j = 0").select("grp", F.col("s").alias("n"))
    return cells.join(n, "grp").select("grp", "i", "j", F.round(F.col("s") / F.col("n"), 3).alias("s"))


@query("n0_gram_wide", "emb", """, e AS (SELECT vec_id, generate_subscripts(vec, 1) AS k, unnest(vec) AS v FROM emb)
    SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, ROUND(SUM(a.v * b.v), 6) AS s FROM e a JOIN e b
    ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2""")
def n0b(t: Tables):
    return rounded(moments.gram_of_vector(t.emb, "vec", EMB_DIM).where("i > 0"), 6, "s")


def _corr_union(cols: list[str], src: str, upper: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, COUNT(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {src}"
        for i, a in enumerate(cols) for j, b in enumerate(cols) if not upper or i < j)


@query("n1_correlation_matrix", "holes", f", c AS ({_corr_union(HOLES, 'holes')}) SELECT a, b, ROUND(r, 8) AS r FROM c")
def n1(t: Tables):
    return rounded(correlate.correlation_matrix(t.holes, HOLES), 8, "r")


@query("n2_correlation_test", "holes", f""", c AS ({_corr_union(HOLES, 'holes', True)})
    SELECT a, b, n, ROUND(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM c""")
def n2(t: Tables):
    pairs = correlate.with_pvalues(correlate.correlation_pairs(t.holes, HOLES)).where("i < j")
    return pairs.select("a", "b", "n", F.round("t", 5).alias("t"))


@query("n2_correlation_pvalues")
def n2b(t: Tables):
    return correlate.correlation_pvalues(t.holes, HOLES)


@query("n3_significant_pairs", "daily", f""", c AS ({_corr_union(DAILY, 'daily', True)})
    SELECT a, b, n, ROUND(r, 8) AS r FROM c WHERE abs(r) * sqrt((n - 2) / (1 - r * r)) >= 10""")
def n3(t: Tables):
    pairs = correlate.significant_pairs(t.daily, DAILY, 0.01)
    strong = F.abs("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))) >= 10
    return pairs.where(strong).select("a", "b", "n", F.round("r", 8).alias("r"))


@query("n4_cross_correlation", "cents daily", """, s AS (SELECT entity, SUM(value) AS total FROM cents GROUP BY 1 ORDER BY total DESC, entity LIMIT 5),
    j AS (SELECT * FROM cents JOIN daily USING (ts) WHERE entity IN (SELECT entity FROM s)) """ + " UNION ALL ".join(
    f"SELECT entity, '{p}' AS feature, ROUND(corr(value, {p}), 8) AS r FROM j GROUP BY entity" for p in DAILY))
def n4(t: Tables):
    return rounded(correlate.cross_correlation(t.cents, t.daily, DAILY, 5), 8, "r")


@query("n5_correlation_histogram", "daily", f""", c AS ({_corr_union(DAILY, 'daily')}), v AS (SELECT ROUND(r, 8) AS r FROM c),
    g AS (SELECT MIN(r) AS lo, (MAX(r) - MIN(r)) / 30 AS w, COUNT(*) AS n FROM v),
    b AS (SELECT CAST(least(29, floor((r - lo) / w)) AS INTEGER) AS bin, lo, w, n FROM v, g)
    SELECT bin, ROUND(lo + bin * w, 6) AS "left", COUNT(*) AS count, ROUND(COUNT(*) / (n * w), 5) AS density FROM b GROUP BY bin, lo, w, n""")
def n5(t: Tables):
    matrix = rounded(correlate.correlation_matrix(t.daily, DAILY), 8, "r")
    return rounded(rounded(correlate.correlation_histogram(matrix), 6, "left"), 5, "density")
