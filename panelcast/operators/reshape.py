"""Wide to long, long to wide, dummies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ordering import ranged_totals
from panelcast.session import cut_lineage


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Only ``ids`` and ``cols`` are read: the projection comes before the unpivot."""
    narrow = df.select(*ids, *cols)
    return narrow.unpivot(list(ids), list(cols), name, value)


def to_wide(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence | None = None
) -> DataFrame:
    """One column per name. Known names avoid the extra job that looks them up."""
    grouped = df.groupBy(*keys)
    grouped = grouped.pivot(name, list(names)) if names is not None else grouped.pivot(name)
    return grouped.agg(F.first(value, ignorenulls=True))


def all_columns_long(df: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Every column becomes a row (for one-row summaries)."""
    return df.unpivot([], list(df.columns), name, value)


def design_matrix(df: DataFrame, keep: Sequence[str], xs: Sequence[str], levels: Mapping[str, Sequence]) -> DataFrame:
    """Intercept, numeric columns as they are, factors as dummies without their first level."""
    out = [F.lit(1.0).alias("intercept")]
    for x in xs:
        if x in levels:
            out += [
                F.when(F.col(x) == lv, 1.0).otherwise(0.0).alias(f"{x}_{lv}") for lv in list(levels[x])[1:]
            ]
        else:
            out.append(F.col(x).cast("double").alias(x))
    return df.select(*keep, *out)


def factor_levels(df: DataFrame, col: str, limit: int | None = None) -> list:
    """Sorted levels of a factor, one name each on the driver; more than a given ``limit`` are refused, not cut."""
    levels = df.select(col).where(F.col(col).isNotNull()).distinct()
    rows = (levels if limit is None else levels.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} levels and is no factor")
    return sorted(r[0] for r in rows)


def level_order(df: DataFrame, col: str) -> DataFrame:
    """``(level, pos)``: the levels of a factor of any size and their places (from 0) in its order."""
    levels = df.select(F.col(col).alias("level")).where("level is not null").distinct()
    return ranged_totals(levels, [], [F.asc("level")], F.lit(1), "pos").select("level", (F.col("pos") - 1).alias("pos"))


#: Columns that a row of ``entity_columns`` holds.
BLOCK = 1000
#: Parts of the dates in which the columns of a block are filled.
SPREAD = 16


def entity_columns(
    forecast: DataFrame, members: DataFrame, names: DataFrame, ts: str = "ts", value: str = "value", block: int = BLOCK
) -> DataFrame:
    """Copy each cluster series to its member entities, one column per entity in the order of ``names`` (``level_order``).

    A date has a row ``(ts, block, entities, values)`` for each ``block`` columns that have a cluster with that date, so
    neither plan nor driver grows with the columns. Each block gets the series of its own clusters, and its columns are filled in
    the task that holds both. An entity of several clusters has the first of them that is known.
    """
    spark = forecast.sparkSession
    series = forecast.where(F.col("cluster").isNotNull()).groupBy("cluster", ts).agg(F.first(value, ignorenulls=True).alias("v"))
    own = members.where("cluster is not null").groupBy(F.col("entity").alias("level")).agg(F.array_sort(F.collect_set("cluster")).alias("of"))
    placed = cut_lineage(own.join(names, "level").select("level", "pos", "of", F.floor(F.col("pos") / block).cast("int").alias("block")))
    columns = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "of"))).alias("_columns"))
    known = placed.select("block", F.explode("of").alias("cluster")).distinct().join(series, "cluster")
    lines = known.groupBy("block", ts).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "v"))).alias("_v"))
    parts = 4 * spark.sparkContext.defaultParallelism  # named, since a few small rows become many cells
    lines = lines.withColumn("_part", F.pmod(F.xxhash64(ts), F.lit(SPREAD))).repartition(parts, "block", "_part")
    copies = columns.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))).repartition(parts, "block", "_part")
    cell = lambda c: F.get(F.filter(F.transform(c["of"], lambda o: F.try_element_at("_v", o)), lambda v: v.isNotNull()), F.lit(0))
    return lines.join(copies.hint("merge"), ["block", "_part"]).select(
        ts, "block", F.transform("_columns", lambda c: c["level"]).alias("entities"), F.transform("_columns", cell).alias("values")
    )


def open_entities(wide: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(ts, entity, value)`` of the blocks of columns of (whole-numbered) entities, without the empty cells."""
    cells = F.inline(F.arrays_zip(F.col("entities").alias("entity"), F.col("values").alias(value)))
    long = wide.select(ts, cells).toDF(ts, "entity", value)
    return long.select(ts, F.col("entity").cast("bigint").alias("entity"), value).where(F.col(value).isNotNull())
