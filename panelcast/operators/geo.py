"""Distances, neighbours and the neighbour report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions.calendar import year_month
from panelcast.functions.scalars import haversine_m, mercator_x, mercator_y
from panelcast.operators.aggregate import last_value_by, mean_by, period_rollup
from panelcast.operators.frame import filter_between, filter_in
from panelcast.operators.joins import lookup_dim
from panelcast.operators.reshape import to_wide

SALT_ROWS = 50_000  # rows of one grid cell handled per join task


def project_mercator(dim: DataFrame) -> DataFrame:
    """Planar metres ``x``, ``y`` from lon/lat."""
    return dim.withColumns({"x": mercator_x(F.col("lon")), "y": mercator_y(F.col("lat"))})


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def neighbor_join(points: DataFrame, radius: float, entity: str = "entity", digits: int | None = None, first: int | None = None) -> DataFrame:
    """All ordered pairs with 0 < planar distance <= radius.

    Entities are reduced to distinct positions first (coincident points are no neighbours, however
    many there are), positions meet only within the 3 x 3 grid cells around them, and a crowded cell
    is split over several tasks by salting. Entities are attached to the pairs of positions last, in
    lists of at most CHUNK, so that pairs of entities are never shuffled. ``digits`` rounds positions
    and distances once for each pair of positions. ``first`` keeps the pairs of each row with that many least neighbours.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")
    spots = points.select("x", "y").distinct().withColumns({"cx": cell("x"), "cy": cell("y")})
    crowd = spots.groupBy("cx", "cy").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    salted = spots.join(crowd, ["cx", "cy"]).withColumn(
        "salt", F.pmod(F.xxhash64("x", "y"), F.col("salts")).cast("int")
    )
    right = salted.select(F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", "salt")
    # each left position visits the salts of the cells around it that exist
    left = (
        spots.select("x", "y", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
        .withColumn("dx", F.explode(near))
        .withColumn("dy", F.explode(near))
        .select("x", "y", (F.col("ox") + F.col("dx")).alias("cx"), (F.col("oy") + F.col("dy")).alias("cy"))
        .join(crowd, ["cx", "cy"])
        .select("x", "y", "cx", "cy", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    )
    d = planar_distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    pairs = (
        left.join(right, ["cx", "cy", "salt"])
        .withColumn("distance", d)
        .where((F.col("distance") > 0) & (F.col("distance") <= radius))
        .select("x", "y", "x2", "y2", "distance")
    )
    if first is not None:
        origin = points.select("x", "y", F.col(entity))
        out = _least_neighbors(pairs, points, entity, first).join(origin, ["x", "y"]).select(entity, F.inline("_near"), "x", "y")
        return _rounded(out.select(entity, "neighbor", "x", "y", "x2", "y2", "distance"), digits)
    parts = 4 * points.sparkSession.sparkContext.defaultParallelism  # named, since a few small rows become many pairs
    lists = _chunks(points, entity)
    # text keys: joins on doubles deal the rows again, into few parts
    place = lambda x, y: F.concat_ws(" ", (F.col(x) + 0.0).cast("string"), (F.col(y) + 0.0).cast("string"))
    origin = lists.select(place("x", "y").alias("_a"), F.col("_ids").alias("_from")).repartition(parts, "_a")
    other = lists.select(place("x", "y").alias("_b"), F.col("_ids").alias("_to")).repartition(parts, "_b")
    met = pairs.withColumns({"_a": place("x", "y"), "_b": place("x2", "y2")}).repartition(parts, "_a").join(origin.hint("merge"), "_a")
    met = met.repartition(parts, "_b").join(other.hint("merge"), "_b")
    met = _rounded(met, digits).withColumn(entity, F.explode("_from"))
    return met.withColumn("neighbor", F.explode("_to")).select(entity, "neighbor", "x", "y", "x2", "y2", "distance")


#: Entities of one position that are listed together.
CHUNK = 1000


def _chunks(points: DataFrame, entity: str) -> DataFrame:
    """(x, y, _ids): the entities of each position in lists of about CHUNK, a row's entity once for the row."""
    many = points.groupBy("x", "y").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_parts"))
    dealt = points.select("x", "y", F.col(entity).alias("_id")).join(many, ["x", "y"])
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")))
    # a list leaves out null: it is wrapped while it is gathered
    return dealt.groupBy("x", "y", "_part").agg(F.collect_list(F.struct("_id")).alias("_l")).select("x", "y", F.transform("_l", lambda s: s["_id"]).alias("_ids"))


def _least_neighbors(pairs: DataFrame, points: DataFrame, entity: str, first: int) -> DataFrame:
    """(x, y, _near): of each position the ``first`` least neighbours, from the ``first`` least entities of each position; null comes first."""
    w = W.partitionBy("x", "y").orderBy(F.asc_nulls_first(entity))
    few = points.where("x is not null and y is not null").select("x", "y", F.col(entity), F.row_number().over(w).alias("_n")).where(F.col("_n") <= first)
    held = few.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col(entity).alias("neighbor"))
    met = pairs.join(held, ["x2", "y2"]).select("x", "y", F.struct("neighbor", "x2", "y2", "distance").alias("_e"))
    near = met.groupBy("x", "y", F.pmod(F.xxhash64("_e"), F.lit(64)).alias("_part")).agg(F.slice(F.array_sort(F.collect_list("_e")), 1, first).alias("_l"))
    return near.groupBy("x", "y").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_l"))), 1, first).alias("_near"))


def _rounded(df: DataFrame, digits: int | None) -> DataFrame:
    return df if digits is None else df.withColumns({c: F.round(c, digits) for c in ("x", "y", "x2", "y2", "distance")})


def neighbors(dim: DataFrame, origin, radius: float, mode: str = "planar", include_self: bool = False) -> DataFrame:
    """Entities within ``radius`` metres of one entity (one scan, the origin is a scalar subquery).

    ``planar`` measures on the projected plane (stretched by 1/cos(lat)), ``haversine`` on the sphere.
    """
    pts = project_mercator(dim)
    o = pts.where(F.col("entity") == origin).select(F.struct("x", "y", "lat", "lon").alias("o")).scalar()
    out = pts.withColumn("_o", o)
    if mode == "planar":
        d = planar_distance(F.col("_o.x"), F.col("_o.y"), F.col("x"), F.col("y"))
    elif mode == "haversine":
        d = haversine_m(F.col("_o.lat"), F.col("_o.lon"), F.col("lat"), F.col("lon"))
    else:
        raise ValueError(f"unknown distance mode {mode!r}")
    out = out.withColumn("distance", d).where(F.col("distance") <= radius)
    return (out if include_self else out.where(F.col("distance") > 0)).drop("_o")


def neighbor_lines(pairs: DataFrame) -> DataFrame:
    """Origin and destination coordinates of every pair."""
    return pairs.select(
        "entity", "neighbor",
        F.col("x").alias("from_x"), F.col("y").alias("from_y"),
        F.col("x2").alias("to_x"), F.col("y2").alias("to_y"),
    )


def neighbor_report(
    dim: DataFrame, panel: DataFrame, origin, radius: float, lo, hi, periods: Sequence[str]
) -> DataFrame:
    """One row per station within the radius: elevation, km, and one column per month of production.

    The panel is cut to the date range and to the stations in range before the roll-up.
    """
    near = neighbors(dim, origin, radius, include_self=True)
    part = filter_in(filter_between(panel, "ts", lo, hi), "entity", near.select("entity"))
    wide = to_wide(period_rollup(part), ["entity"], "period", "value", periods)
    head = near.select(
        "entity", F.bround(F.col("elev").cast("double"), 0).alias("elev"), F.bround(F.col("distance") / 1000, 0).alias("distance_km")
    )
    return head.join(wide, "entity", "left")


def neighbor_daily(dim: DataFrame, panel: DataFrame, origin, radius: float, lo, hi) -> DataFrame:
    """The daily series of the stations in range (long)."""
    near = neighbors(dim, origin, radius, include_self=True)
    return filter_in(filter_between(panel, "ts", lo, hi), "entity", near.select("entity"))


def months_between(lo: str, hi: str) -> list[str]:
    """Month names ``yyyy-MM`` of a closed date range."""
    (y, m), (y2, m2) = (tuple(map(int, d.split("-")[:2])) for d in (lo, hi))
    out = []
    while (y, m) <= (y2, m2):
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def neighbor_listing(pairs: DataFrame, k: int = 5) -> DataFrame:
    """Text ``entity, n1, ..., nk`` per entity, with ``...`` when there are more neighbours.

    Only the first k neighbours per entity are gathered, the rest are just counted.
    """
    w = W.partitionBy("entity").orderBy("neighbor")
    first = (
        pairs.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= k)
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "neighbor"))).alias("l"))
    )
    count = pairs.groupBy("entity").agg(F.count("*").alias("n"))
    text = F.array_join(
        F.concat(F.array(F.col("entity").cast("string")), F.transform("l", lambda s: s["neighbor"].cast("string"))), ", "
    )
    return first.join(count, "entity").select(
        "entity", F.concat(text, F.when(F.col("n") > k, "...").otherwise("")).alias("listing")
    )


def position_table(panel: DataFrame, dim: DataFrame, how: str = "last") -> DataFrame:
    """Last or mean value per entity with its coordinates."""
    agg = last_value_by(panel) if how == "last" else mean_by(panel, ["entity"])
    return lookup_dim(agg.toDF("entity", "value"), dim)
