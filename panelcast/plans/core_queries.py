"""Queries for sources, projection, filters, reshape, joins, aggregates, windows, ranks, sets, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import calendar as cal
from panelcast.functions import scalars as sc
from panelcast.operators import aggregate as agg
from panelcast.operators import frame, geo, joins, ordering, rank, reshape, window
from panelcast.plans.registry import query
from panelcast.plans.tables import EVENT_TYPES, Tables
from panelcast.session import scratch_path
from panelcast.sources.readers import nan_to_null, read_panel, read_stations, write_submission
from panelcast.sources.store import Store

EVT = ", ".join(f'"{e}"' for e in EVENT_TYPES)


# ---- A: sources, sinks, store ----


@query("a1_read_panel", sql="""
    SELECT l_suppkey, l_linenumber, CASE WHEN l_tax <> 0.0 THEN l_tax END AS l_tax, l_extendedprice
    FROM lineitem""")
def a1(t: Tables):
    li = read_panel(t.spark, f"{t.sf_dir}/lineitem.parquet")
    holed = li.withColumn("l_tax", F.when(F.col("l_tax") == 0.0, float("nan")).otherwise(F.col("l_tax")))
    return nan_to_null(holed).select("l_suppkey", "l_linenumber", "l_tax", "l_extendedprice")


@query("a2_read_stations", "dim", "SELECT entity, lat, lon, elev FROM dim")
def a2(t: Tables):
    path = scratch_path(t.spark, "stations")
    t.dim.write.option("header", True).csv(path)
    schema = T.StructType(
        [T.StructField("entity", T.LongType()), T.StructField("lat", T.DoubleType()),
         T.StructField("lon", T.DoubleType()), T.StructField("elev", T.IntegerType())]
    )
    return read_stations(t.spark, path, schema)


@query("a3_write_submission", "wide", f"SELECT ts, {EVT} FROM wide")
def a3(t: Tables):
    path = scratch_path(t.spark, "submission")
    write_submission(t.wide, path)
    return read_panel(t.spark, path, t.wide.schema, fmt="csv")


@query("a4_store", "panel", "SELECT entity, SUM(1)::BIGINT AS n, MAX(value) AS top FROM panel GROUP BY entity")
def a4(t: Tables):
    store = Store(t.spark, scratch_path(t.spark, "store"), "base")
    make = lambda: t.panel.groupBy("entity").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    store.load_or_compute("profile", make)
    return store.load_or_compute("profile", make)


# ---- B: projection, rename, derived columns ----


@query("b1_select_block", "wide", 'SELECT ts, "click", "view" FROM wide')
def b1(t: Tables):
    return frame.select_block(t.wide, ["ts", "click", "view"])


@query("b2_drop_block", "wide", 'SELECT ts, "error", "purchase", "signup" FROM wide')
def b2(t: Tables):
    return frame.drop_block(frame.drop_block(t.wide, ["click", "view"]), ["nowhere"], strict=False)


@query("b3_column_blocks", "wide", """
    SELECT 'targets' AS block, ROUND(SUM("click" + "error"), 2) AS total FROM wide
    UNION ALL SELECT 'predictors', ROUND(SUM("purchase" + "signup"), 2) FROM wide
    UNION ALL SELECT 'others', ROUND(SUM("view"), 2) FROM wide""")
def b3(t: Tables):
    blocks = frame.column_blocks(t.wide.drop("ts").columns, slice(0, 2), slice(2, 4))
    long = reshape.to_long(t.wide, [], EVENT_TYPES)
    block = F.when(F.col("name").isin(blocks["targets"]), "targets").when(
        F.col("name").isin(blocks["predictors"]), "predictors").otherwise("others")
    return agg.total_by(long.withColumn("block", block), ["block"]).withColumn("total", F.round("total", 2))


@query("b4_rename", "panel", "SELECT entity AS station, ts AS day, value FROM panel")
def b4(t: Tables):
    return frame.rename(t.panel, {"entity": "station", "ts": "day"})


@query("b5_suffix_columns", "daily", """SELECT ts, d_qty AS d_qty_daily, d_disc AS d_disc_daily,
    d_tax AS d_tax_daily, d_lines AS d_lines_daily, d_price AS d_price_daily, d_ret AS d_ret_daily FROM daily""")
def b5(t: Tables):
    return frame.suffix_columns(t.daily, "d_", "_daily")


@query("b6_numeric_columns", sql="""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax FROM lineitem""")
def b6(t: Tables):
    return t.lineitem.select(*frame.numeric_columns(t.lineitem))


@query("b7_add_calendar", "panel", """SELECT entity, ts, value, CAST(year(ts) AS INTEGER) AS year,
    CAST(month(ts) AS INTEGER) AS month, strftime(ts, '%b') AS month_label, strftime(ts, '%Y-%m') AS year_month,
    CAST(day(ts) AS INTEGER) AS day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year,
    CAST(dayofweek(ts) + 1 AS INTEGER) AS day_of_week, CAST(isodow(ts) AS INTEGER) AS day_of_week_monday,
    strftime(ts, '%a') AS day_of_week_label,
    CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Workday' END AS weekend,
    CAST(date_diff('day', DATE '1970-01-01', ts) AS DOUBLE) AS days_since_origin FROM panel""")
def b7(t: Tables):
    return cal.add_calendar(t.panel)


@query("b8_label_if", "panel", """SELECT entity, ts,
    CASE WHEN ts < DATE '2000-01-01' THEN 'Train' ELSE 'Test' END AS part FROM panel""")
def b8(t: Tables):
    return t.panel.select("entity", "ts", sc.label_if(F.col("ts") < F.lit("2000-01-01").cast("date"), "Train", "Test").alias("part"))


@query("b9_rescale", "panel", "SELECT entity, ts, value / 1e6 AS value FROM panel")
def b9(t: Tables):
    return frame.rescale(t.panel, "value", 1e6)


@query("b10_entity_label", "panel dim", """, l AS (SELECT entity, arg_max(value, ts) AS last FROM panel GROUP BY 1)
    SELECT entity, CAST(entity AS VARCHAR) || ' / Elevation: ' || CAST(elev AS VARCHAR) ||
      ' m / Last production: ' || printf('%.1f', round_even(last / 1e6, 1)) || ' million' AS label
    FROM l JOIN dim USING (entity)""")
def b10(t: Tables):
    last = agg.last_value_by(t.panel).join(t.dim, "entity")
    text = F.format_string(
        "%s / Elevation: %d m / Last production: %.1f million",
        F.col("entity").cast("string"), "elev", F.bround(F.col("last") / F.lit(1e6), 1),
    )
    return last.select("entity", text.alias("label"))


RANKED = ", r AS (SELECT entity, SUM(value) AS total, ROW_NUMBER() OVER (ORDER BY ROUND(SUM(value), 2) DESC, entity) AS rank FROM panel GROUP BY entity)"


@query("b11_with_order", "panel", RANKED + " SELECT p.entity, ts, rank AS \"order\" FROM panel p JOIN r USING (entity)")
def b11(t: Tables):
    return frame.with_order(t.panel, rank.rank_entities(t.panel)).select("entity", "ts", "order")


# ---- C: filters ----


@query("c1_filter_in", "panel", RANKED + " SELECT entity, ts, value FROM panel WHERE entity IN (SELECT entity FROM r WHERE rank <= 7)")
def c1(t: Tables):
    return frame.filter_in(t.panel, "entity", rank.top_k(t.panel, 7).select("entity"))


@query("c2_filter_between", "panel", "SELECT * FROM panel WHERE ts BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def c2(t: Tables):
    return frame.filter_between(t.panel, "ts", "1997-03-01", "1998-02-28").select("entity", "ts", "value")


@query("c3_filter_latest_year", "panel", "SELECT * FROM panel WHERE year(ts) = (SELECT year(MAX(ts)) FROM panel)")
def c3(t: Tables):
    return frame.filter_latest_year(t.panel)


INDEX = ", ix AS (SELECT ts, ROW_NUMBER() OVER (ORDER BY ts) AS idx FROM (SELECT DISTINCT ts FROM total))"


@query("c4_slice_rows", "total", INDEX + " SELECT ts, value, idx FROM total JOIN ix USING (ts) WHERE idx BETWEEN 100 AND 400")
def c4(t: Tables):
    return frame.slice_rows(ordering.row_index(t.total), 100, 400).select("ts", "value", "idx")


@query("c5_drop_nulls", "holes", "SELECT * FROM holes WHERE tax IS NOT NULL AND discount IS NOT NULL")
def c5(t: Tables):
    return frame.drop_nulls(t.holes, ["tax", "discount"])


@query("c6_head_k", "total", "SELECT ts, value FROM total ORDER BY value DESC, ts LIMIT 5")
def c6(t: Tables):
    return frame.head_k(t.total, 5, F.desc("value"), F.asc("ts")).select("ts", "value")


@query("c7_threshold_flag", "panel", """SELECT entity, ts, value >= 100000 AS high, value <= 5000 AS low FROM panel""")
def c7(t: Tables):
    high = frame.threshold_flag(t.panel, "value", 100000.0, "high")
    return frame.threshold_flag(high, "value", 5000.0, "low", below=True).drop("value")


# ---- D: reshape ----


@query("d1_to_long", "wide", " UNION ALL ".join(f"SELECT ts, '{e}' AS name, \"{e}\" AS value FROM wide" for e in EVENT_TYPES))
def d1(t: Tables):
    return reshape.to_long(t.wide, ["ts"], EVENT_TYPES)


YEARS = list(range(1995, 2002))


@query("d2_to_wide", "panel", "SELECT entity, " + ", ".join(
    f"SUM(CASE WHEN year(ts) = {y} THEN 1 END)::BIGINT AS y{y}" for y in YEARS) + " FROM panel GROUP BY entity")
def d2(t: Tables):
    counts = agg.count_by(t.panel.withColumn("year", F.concat(F.lit("y"), F.year("ts"))), ["entity", "year"])
    return reshape.to_wide(counts, ["entity"], "year", "n", [f"y{y}" for y in YEARS])


@query("d3_all_columns_long", "wide", " UNION ALL ".join(
    f"SELECT '{e}' AS name, MAX(\"{e}\") AS value FROM wide" for e in EVENT_TYPES))
def d3(t: Tables):
    return reshape.all_columns_long(t.wide.agg(*[F.max(e).alias(e) for e in EVENT_TYPES]))


@query("d4_design_matrix", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1.0::DOUBLE AS intercept,
    l_quantity, CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_N",
    CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "l_returnflag_R" FROM lineitem""")
def d4(t: Tables):
    levels = {"l_returnflag": reshape.factor_levels(t.lineitem, "l_returnflag")}
    return reshape.design_matrix(
        t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_returnflag"], levels)


@query("d5_entity_columns", "panel clusters", """,
    f AS (SELECT cluster, ts, ROUND(SUM(value), 2) AS value FROM panel JOIN clusters USING (entity) GROUP BY 1, 2)
    SELECT ts, entity, value FROM clusters JOIN f USING (cluster)""")
def d5(t: Tables):
    series = (t.panel.join(t.clusters, "entity").groupBy("cluster", "ts")
              .agg(F.round(F.sum("value"), 2).alias("value")))
    return reshape.open_entities(reshape.entity_columns(series, t.clusters, reshape.level_order(t.clusters, "entity")))


# ---- E: joins ----


@query("e1_left_join_suffix", "total daily", """SELECT t.ts, t.value AS value_prod, d.value AS value_pred, d_lines
    FROM total t LEFT JOIN (SELECT ts, d_qty AS value, d_lines FROM daily WHERE d_lines > 5) d USING (ts)""")
def e1(t: Tables):
    pred = t.daily.where(F.col("d_lines") > 5).select("ts", F.col("d_qty").alias("value"), "d_lines")
    return joins.left_join_suffix(t.total, pred, ["ts"], ("_prod", "_pred"))


@query("e2_inner_join", "panel dim", """SELECT entity, ts, value, elev FROM panel JOIN dim USING (entity)""")
def e2(t: Tables):
    dim = t.dim.select(F.col("entity").alias("stid"), "elev")
    return joins.inner_join_named(t.panel, dim, "entity", "stid").select("entity", "ts", "value", "elev")


@query("e3_lookup_dim", "cents dim", """SELECT entity, mean, lat, lon, elev FROM
    (SELECT entity, AVG(value) AS mean FROM cents GROUP BY entity) LEFT JOIN dim USING (entity)""")
def e3(t: Tables):
    return joins.lookup_dim(agg.mean_by(t.cents, ["entity"]), t.dim)


@query("e4_merge_stats", "cents", """SELECT entity, AVG(value) AS mean, ROUND(stddev_samp(value), 2) AS sd,
    COUNT(*) AS n FROM cents GROUP BY entity""")
def e4(t: Tables):
    sd = t.cents.groupBy("entity").agg(F.round(F.stddev_samp("value"), 2).alias("sd"))
    return joins.merge_stats([agg.mean_by(t.cents, ["entity"]), sd, agg.count_by(t.cents, ["entity"])], "entity")


@query("e5_zip_by_key", "total daily", "SELECT ts, value, d_qty, d_lines FROM total JOIN daily USING (ts)")
def e5(t: Tables):
    return joins.zip_by_key(t.total, t.daily.select("ts", "d_qty", "d_lines"))


XY = """, pt AS (SELECT entity, radians(lon) * 6378137.0::DOUBLE AS x,
      ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2)) * 6378137.0::DOUBLE AS y, lat, lon, elev FROM dim)"""


@query("e6_neighbor_join", "dim", XY + """ SELECT a.entity, b.entity AS neighbor,
    ROUND(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 3) AS distance FROM pt a, pt b
    WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 100000""")
def e6(t: Tables):
    pairs = geo.neighbor_join(geo.project_mercator(t.dim), 100_000.0, digits=3)
    return pairs.select("entity", "neighbor", "distance")


FOLDS = """, n AS (SELECT COUNT(*) AS n FROM total), fo AS (SELECT i AS fold, 365 + i * 366 AS stop
      FROM n, range(0, 1 + (n.n - 365 - 180) // 366) r(i))"""


@query("e7_range_join_folds", "total", INDEX + FOLDS + """, w AS (
      SELECT fold, 'train' AS role, stop - 364 AS lo, stop AS hi FROM fo
      UNION ALL SELECT fold, 'test', stop + 1, stop + 180 FROM fo)
    SELECT CAST(fold AS INTEGER) AS fold, role, ts, idx, value FROM total JOIN ix USING (ts) JOIN w ON idx BETWEEN lo AND hi""")
def e7(t: Tables):
    from panelcast.operators.splits import time_slices

    indexed = ordering.row_index(t.total)
    folds = time_slices(indexed, initial=365, horizon=180, skip=365, fixed=True)
    return joins.range_join_folds(indexed, folds).select("fold", "role", "ts", "idx", "value")


# ---- F: aggregates ----


@query("f1_total_by", "panel", "SELECT entity, CAST(year(ts) AS INTEGER) AS year, ROUND(SUM(value), 2) AS total FROM panel GROUP BY 1, 2")
def f1(t: Tables):
    return agg.total_by(t.panel.withColumn("year", F.year("ts")), ["entity", "year"]).withColumn("total", F.round("total", 2))


@query("f2_mean_by", "cents", "SELECT ts, AVG(value) AS mean FROM cents GROUP BY 1")
def f2(t: Tables):
    return agg.mean_by(t.cents, ["ts"])


def _profile_sql(suffix: str, last: bool) -> str:
    s = suffix
    return f"""SELECT entity, AVG(value) AS mean{s}, ROUND(stddev_samp(value), 2) AS sd{s},
      quantile_cont(value, 0.25) AS q25{s}, quantile_cont(value, 0.5) AS q50{s},
      quantile_cont(value, 0.75) AS q75{s}, MAX(value) AS max{s}, MIN(value) AS min{s},
      arg_min(value, ts) AS first{s}{", arg_max(value, ts) AS last" if last else ""}"""


@query("f3_entity_profile", "cents", _profile_sql("", True) + " FROM cents GROUP BY entity")
def f3(t: Tables):
    return agg.entity_profile(t.cents).withColumn("sd", F.round("sd", 2))


@query("f4_entity_profile_latest_year", "cents", _profile_sql("_last_year", False) +
       " FROM cents WHERE year(ts) = (SELECT year(MAX(ts)) FROM cents) GROUP BY entity")
def f4(t: Tables):
    return agg.entity_profile_latest_year(t.cents).withColumn("sd_last_year", F.round("sd_last_year", 2))


@query("f5_last_value_by", "panel", "SELECT entity, arg_max(value, ts) AS last FROM panel GROUP BY entity")
def f5(t: Tables):
    return agg.last_value_by(t.panel)


HOLE_COLS = ["price", "quantity", "tax", "discount"]


@query("f6_column_stats", "holes", " UNION ALL ".join(f"""SELECT '{c}' AS variable, ROUND(AVG({c}), 6) AS mean,
    ROUND(quantile_cont({c}, 0.5), 6) AS median, ROUND(stddev_samp({c}), 6) AS sd,
    ROUND(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / COUNT(*)::DOUBLE, 6) AS null_share FROM holes""" for c in HOLE_COLS))
def f6(t: Tables):
    out = agg.column_stats(t.holes, HOLE_COLS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "sd", "null_share")})


@query("f7_count_by", "total", INDEX + """ SELECT CAST(year(ts) AS INTEGER) AS year,
    CASE WHEN idx <= 1700 THEN 'Train' ELSE 'Test' END AS part, COUNT(*) AS n FROM total JOIN ix USING (ts) GROUP BY 1, 2""")
def f7(t: Tables):
    df = ordering.row_index(t.total).select(
        F.year("ts").alias("year"), sc.label_if(F.col("idx") <= 1700, "Train", "Test").alias("part"))
    return agg.count_by(df, ["year", "part"])


@query("f8_period_rollup", "panel", """SELECT entity, strftime(ts, '%Y-%m') AS period,
    round_even(SUM(value) / 1e6, 0) AS value FROM panel GROUP BY 1, 2""")
def f8(t: Tables):
    return agg.period_rollup(t.panel)


DISTINCT_COLS = ["l_suppkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag"]


@query("f9_distinct_count", sql="WITH h AS (SELECT * REPLACE (CASE WHEN l_tax <> 0.0 THEN l_tax END AS l_tax) FROM lineitem) " +
       " UNION ALL ".join(f"""SELECT '{c}' AS variable, CAST(COUNT(DISTINCT {c}) +
         MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM h""" for c in DISTINCT_COLS))
def f9(t: Tables):
    return agg.distinct_count(t.lineitem.withColumn("l_tax", F.when(F.col("l_tax") != 0.0, F.col("l_tax"))), DISTINCT_COLS)


# ---- G: windows ----


@query("g1_rank_first", "panel", """, y AS (SELECT CAST(year(ts) AS INTEGER) AS year, entity, ROUND(SUM(value), 2) AS total FROM panel GROUP BY 1, 2)
    SELECT year, entity, total, ROW_NUMBER() OVER (PARTITION BY year ORDER BY total DESC, entity) AS rank FROM y""")
def g1(t: Tables):
    yearly = t.panel.groupBy(F.year("ts").alias("year"), "entity").agg(F.round(F.sum("value"), 2).alias("total"))
    return rank.rank_first(yearly, ["year"], [F.desc("total"), F.asc("entity")])


@query("g2_add_lags", "panel", """, l AS (SELECT entity, ts, value, """ + ", ".join(
    f"LAG(value, {30 * i}) OVER w AS value_lag_{30 * i}" for i in range(1, 6)) + """, ROW_NUMBER() OVER w AS rn
    FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts)) SELECT * EXCLUDE (rn) FROM l WHERE rn > 150""")
def g2(t: Tables):
    return window.add_lags(t.panel, 30, 5)


def _centered_sql(width: int, src: str, key: str) -> str:
    h = width // 2
    total = f"SUM(value) OVER w"
    if width % 2 == 0:
        total = f"({total} - (LAG(value, {h}) OVER o + LEAD(value, {h}) OVER o) / 2)"
    return f"""SELECT {key}, ts, CASE WHEN COUNT(value) OVER w = {2 * h + 1} THEN {total} / {width} END AS trend
      FROM {src} WINDOW o AS (PARTITION BY {key} ORDER BY ts),
      w AS (PARTITION BY {key} ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"""


@query("g3_centered_mean", "dense", f""", a AS ({_centered_sql(365, 'dense', 'entity')}), b AS ({_centered_sql(30, 'dense', 'entity')})
    SELECT a.entity, a.ts, a.trend, b.trend AS trend_even FROM a JOIN b USING (entity, ts)""")
def g3(t: Tables):
    odd = window.centered_mean(t.dense, 365)
    even = window.centered_mean(odd, 30, name="trend_even")
    return even.select("entity", "ts", "trend", "trend_even")


@query("g4_row_index", "panel", """SELECT entity, ts, value, DENSE_RANK() OVER (ORDER BY ts) AS idx FROM panel""")
def g4(t: Tables):
    return ordering.row_index(t.panel).select("entity", "ts", "value", "idx")


@query("g5_zscore", "panel", """SELECT entity, ts, ROUND((value - AVG(value) OVER (PARTITION BY entity)) /
    NULLIF(stddev_samp(value) OVER (PARTITION BY entity), 0), 6) AS z FROM panel""")
def g5(t: Tables):
    return window.zscore(t.panel, "value", ["entity"]).select("entity", "ts", F.round("z", 6).alias("z"))


# ---- H: sort, limit, top-k ----


@query("h1_rank_entities", "panel", RANKED + " SELECT entity, ROUND(total, 2) AS total, rank FROM r")
def h1(t: Tables):
    return rank.rank_entities(t.panel).withColumn("total", F.round("total", 2))


@query("h2_top_bottom", "panel", """, s AS (SELECT entity, ROUND(SUM(value), 2) AS total FROM panel GROUP BY entity),
    a AS (SELECT 'top' AS side, * FROM s ORDER BY total DESC, entity LIMIT 7),
    b AS (SELECT 'bottom' AS side, * FROM s ORDER BY total, entity LIMIT 7) SELECT * FROM a UNION ALL SELECT * FROM b""")
def h2(t: Tables):
    top = rank.top_k(t.panel, 7).select(F.lit("top").alias("side"), "entity", "total")
    low = rank.top_k(t.panel, 7, bottom=True).select(F.lit("bottom").alias("side"), "entity", "total")
    return top.union(low).withColumn("total", F.round("total", 2))


@query("h3_top_features", sql="""WITH s AS (SELECT l_suppkey AS target, p_brand AS feature, ROUND(SUM(l_extendedprice), 2) AS score
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT *,
    CAST(ROW_NUMBER() OVER (PARTITION BY target ORDER BY score DESC, feature) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def h3(t: Tables):
    scores = (
        t.lineitem.join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("target"), F.col("p_brand").alias("feature"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    )
    return rank.top_features(scores, 5)


@query("h4_best_by", "panel", """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY value, ts) AS rn FROM panel)
    SELECT entity, value, ts FROM r WHERE rn = 1""")
def h4(t: Tables):
    return rank.best_by(t.panel, ["entity"], ["value", "ts"])


# ---- I: set operations ----


@query("i1_stack_rows", "panel", """SELECT entity, ts, value, CASE WHEN ts < DATE '1999-01-01' THEN 1 END AS early FROM panel
    WHERE ts < DATE '2001-01-01'""")
def i1(t: Tables):
    train = t.panel.where("ts < DATE '1999-01-01'").withColumn("early", F.lit(1))
    val = t.panel.where("ts >= DATE '1999-01-01' AND ts < DATE '2001-01-01'")
    return frame.stack_rows(train, val)


@query("i2_distinct_values", sql="SELECT DISTINCT l_quantity FROM lineitem")
def i2(t: Tables):
    return frame.distinct_values(t.lineitem, "l_quantity")


@query("i3_column_difference", "wide", 'SELECT "purchase", "signup", "view" FROM wide')
def i3(t: Tables):
    return t.wide.select(*frame.column_difference(t.wide.columns, ["ts", "click", "error"]))


# ---- J: scalar functions ----


def _scalar(name: str, sql_expr: str, make, view: str = "panel"):
    @query(name, view, f"SELECT entity, ts, {sql_expr} AS out FROM {view}")
    def fn(t: Tables):
        return getattr(t, view).select("entity", "ts", make().alias("out"))

    return fn


TS = lambda: F.col("ts")
_scalar("j1_parse_date", "CAST(strptime(strftime(ts, '%Y%m%d'), '%Y%m%d') AS DATE)",
        lambda: cal.parse_date(F.date_format("ts", "yyyyMMdd")))
_scalar("j2_date_parts", "CAST(year(ts) * 1000000 + month(ts) * 100000 + day(ts) * 1000 + dayofyear(ts) AS INTEGER)",
        lambda: F.year("ts") * 1000000 + F.month("ts") * 100000 + F.dayofmonth("ts") * 1000 + F.dayofyear("ts"))
_scalar("j3_day_of_week", "CAST(dayofweek(ts) + 1 AS INTEGER)", lambda: F.dayofweek("ts"))
_scalar("j4_weekday_label", "CAST(isodow(ts) AS VARCHAR) || strftime(ts, '%a')",
        lambda: F.concat(cal.weekday_monday("ts").cast("string"), cal.weekday_label("ts")))
_scalar("j5_month_label", "strftime(ts, '%b')", lambda: cal.month_label("ts"))
_scalar("j6_year_month", "strftime(ts, '%Y-%m')", lambda: cal.year_month("ts"))
_scalar("j7_days_since_origin", "CAST(date_diff('day', DATE '1970-01-01', ts) AS INTEGER)", lambda: F.unix_date("ts"))
_scalar("j8_weekend", "CASE WHEN isodow(ts) >= 6 THEN 'Weekend' ELSE 'Workday' END", lambda: cal.weekend_label("ts"))
_scalar("j9_round_even", "round_even(value / 1e3, 1)", lambda: sc.round_even(F.col("value") / F.lit(1e3), 1))
_scalar("j10_arithmetic", "abs(value - 50000) / (value * value)",
        lambda: F.abs(F.col("value") - F.lit(50000)) / (F.col("value") * F.col("value")))
_scalar("j12_format", "printf('%.1f%% of %d', round_even(value / 1e4, 1), entity)",
        lambda: F.format_string("%.1f%% of %d", F.bround(F.col("value") / F.lit(1e4), 1), F.col("entity")))


@query("j11_grids", "panel", """, m AS (SELECT entity, MAX(value) AS top FROM panel GROUP BY entity)
    SELECT entity, CAST(e AS INTEGER) AS step, ROUND(top * 10.0::DOUBLE ** e, 6) AS point, ROUND(top * (0.25 * (e + 4))::DOUBLE, 6) AS linear
    FROM m, range(-4, 3) r(e)""")
def j11(t: Tables):
    top = t.panel.groupBy("entity").agg(F.max("value").alias("top"))
    steps = F.array(*[F.lit(v) for v in sc.linear_grid(0.0, 1.5, 0.25)])
    return (
        top.select("entity", "top", F.posexplode(sc.power_grid_col(-4, 2, F.col("top"))).alias("i", "point"))
        .select("entity", (F.col("i") - 4).alias("step"), F.round("point", 6).alias("point"),
                F.round(F.col("top") * F.get(steps, F.col("i")), 6).alias("linear"))
    )


@query("j13_null_count", "holes", """SELECT COUNT(*) FILTER (tax IS NULL) AS tax, COUNT(*) FILTER (discount IS NULL) AS discount,
    COUNT(*) AS n FROM holes""")
def j13(t: Tables):
    return t.holes.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("tax", "discount")], F.count("*").alias("n"))


@query("j14_mercator", "dim", XY + " SELECT entity, ROUND(x, 3) AS x, ROUND(y, 3) AS y FROM pt")
def j14(t: Tables):
    return t.dim.select("entity", F.round(sc.mercator_x(F.col("lon")), 3).alias("x"), F.round(sc.mercator_y(F.col("lat")), 3).alias("y"))


# ---- V: geography ----


@query("v1_project_mercator", "dim", XY + " SELECT entity, lat, lon, elev, ROUND(x, 3) AS x, ROUND(y, 3) AS y FROM pt")
def v1(t: Tables):
    return geo.project_mercator(t.dim).withColumns({c: F.round(c, 3) for c in ("x", "y")})


NEAR = """, o AS (SELECT * FROM pt WHERE entity = 3), near AS (SELECT pt.*, sqrt((pt.x - o.x) ** 2 + (pt.y - o.y) ** 2) AS distance,
    2 * 6378137.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin((radians(pt.lat) - radians(o.lat)) / 2) ** 2 +
      cos(radians(o.lat)) * cos(radians(pt.lat)) * sin((radians(pt.lon) - radians(o.lon)) / 2) ** 2))) AS arc FROM pt, o)"""


@query("v2_neighbors", "dim", XY + NEAR + """ SELECT 'planar' AS mode, entity, ROUND(distance, 3) AS distance FROM near
    WHERE distance > 0 AND distance <= 300000 UNION ALL
    SELECT 'haversine', entity, ROUND(arc, 3) FROM near WHERE arc <= 300000""")
def v2(t: Tables):
    a = geo.neighbors(t.dim, 3, 300_000.0).select(F.lit("planar").alias("mode"), "entity", "distance")
    b = geo.neighbors(t.dim, 3, 300_000.0, "haversine", include_self=True).select(F.lit("haversine").alias("mode"), "entity", "distance")
    return a.union(b).withColumn("distance", F.round("distance", 3))


PAIRS = """, pairs AS (SELECT a.entity, b.entity AS neighbor, a.x, a.y, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b
    ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) > 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 150000)"""


@query("v3_neighbor_lines", "dim", XY + PAIRS + """ SELECT entity, neighbor, ROUND(x, 3) AS from_x, ROUND(y, 3) AS from_y,
    ROUND(x2, 3) AS to_x, ROUND(y2, 3) AS to_y FROM pairs""")
def v3(t: Tables):
    return geo.neighbor_lines(geo.neighbor_join(geo.project_mercator(t.dim), 150_000.0, digits=3))


REPORT_LO, REPORT_HI = "1997-10-01", "1998-03-31"
MONTHS = geo.months_between(REPORT_LO, REPORT_HI)


@query("v4_neighbor_report", "panel dim", XY + NEAR + f""", roll AS (SELECT entity, strftime(ts, '%Y-%m') AS period,
      round_even(SUM(value) / 1e6, 0) AS value FROM panel WHERE ts BETWEEN DATE '{REPORT_LO}' AND DATE '{REPORT_HI}' GROUP BY 1, 2)
    SELECT n.entity, round_even(n.elev::DOUBLE, 0) AS elev, round_even(distance / 1000, 0) AS distance_km, """ + ", ".join(
    f"MAX(CASE WHEN period = '{m}' THEN value END) AS \"{m}\"" for m in MONTHS) +
    " FROM near n LEFT JOIN roll USING (entity) WHERE distance <= 300000 GROUP BY 1, 2, 3")
def v4(t: Tables):
    return geo.neighbor_report(t.dim, t.panel, 3, 300_000.0, REPORT_LO, REPORT_HI, MONTHS)


@query("v4_neighbor_daily", "panel dim", XY + NEAR + f""" SELECT entity, ts, value FROM panel
    WHERE ts BETWEEN DATE '{REPORT_LO}' AND DATE '{REPORT_HI}' AND entity IN (SELECT entity FROM near WHERE distance <= 300000)""")
def v4b(t: Tables):
    return geo.neighbor_daily(t.dim, t.panel, 3, 300_000.0, REPORT_LO, REPORT_HI).select("entity", "ts", "value")


@query("v5_neighbor_listing", "dim", XY + PAIRS + """, r AS (SELECT entity, neighbor, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY neighbor) AS rn,
      COUNT(*) OVER (PARTITION BY entity) AS n FROM pairs)
    SELECT entity, CAST(entity AS VARCHAR) || ', ' || string_agg(CAST(neighbor AS VARCHAR), ', ' ORDER BY rn) ||
      CASE WHEN MAX(n) > 5 THEN '...' ELSE '' END AS listing FROM r WHERE rn <= 5 GROUP BY entity""")
def v5(t: Tables):
    return geo.neighbor_listing(geo.neighbor_join(geo.project_mercator(t.dim), 150_000.0, first=6), 5)


@query("v6_position_table", "cents dim", """SELECT how, entity, value, lat, lon, elev FROM (
      SELECT 'last' AS how, entity, arg_max(value, ts) AS value FROM cents GROUP BY entity
      UNION ALL SELECT 'mean', entity, AVG(value) FROM cents GROUP BY entity) LEFT JOIN dim USING (entity)""")
def v6(t: Tables):
    both = [geo.position_table(t.cents, t.dim, how).withColumn("how", F.lit(how)) for how in ("last", "mean")]
    return both[0].unionByName(both[1])
