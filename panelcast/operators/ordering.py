"""Row numbers and running totals over large ordered groups, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.session import cut_lineage


BROADCAST_DATES = 500_000  # rows of (date, index, label)


def _stretch(df: DataFrame, ts: str) -> Column:
    """Calendar stretch that holds few rows of one series: a year of days, or a day of timestamps."""
    return F.year(ts) if isinstance(df.schema[ts].dataType, T.DateType) else F.to_date(ts)


def row_index(df: DataFrame, ts: str = "ts", name: str = "idx") -> DataFrame:
    """1-based index of each date among the distinct dates, joined back to the rows."""
    return join_dates(df, date_index(df, ts, name), ts)


def join_dates(df: DataFrame, dates: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach a table with one row per date; it is sent to every task only if its count allows it."""
    small = dates.count() <= BROADCAST_DATES
    return df.join(F.broadcast(dates) if small else dates, ts)


def date_index(df: DataFrame, ts: str = "ts", name: str = "idx") -> DataFrame:
    """``(ts, idx)`` of the distinct dates, found in one pass and stored.

    The index is built in two steps (within a calendar stretch, plus all earlier stretches), so the
    only window without a partition key runs over one row per year, or per day for timestamps.
    """
    dates = cut_lineage(df.select(ts).where(F.col(ts).isNotNull()).distinct()).withColumn("_y", _stretch(df, ts))
    years = dates.groupBy("_y").agg(F.count("*").alias("_m"))
    before = W.orderBy("_y").rowsBetween(W.unboundedPreceding, -1)
    years = years.select("_y", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_y").orderBy(ts)
    return dates.join(years, "_y").select(
        ts, (F.row_number().over(within) + F.col("_before")).cast("bigint").alias(name)
    )


def entity_index(df: DataFrame, entity: Sequence[str], ts: str = "ts", name: str = "idx") -> DataFrame:
    """1-based row number per entity in date order: within a calendar stretch, plus all earlier ones."""
    keys = list(entity)
    tagged = df.withColumn("_st", _stretch(df, ts))
    sums = tagged.groupBy(*keys, "_st").agg(F.count("*").alias("_m"))
    before = W.partitionBy(*keys).orderBy("_st").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "_st", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys, "_st").orderBy(ts)
    return (
        tagged.withColumn("_rn", F.row_number().over(within))
        .join(sums, [*keys, "_st"])
        .withColumn(name, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_st", "_rn", "_before")
    )


def with_halo(df: DataFrame, idx: str, before: int, after: int, rows: int | None = None) -> DataFrame:
    """Cut every series into blocks of ``rows`` index values and copy edge rows into the neighbours.

    Adds ``_block`` and ``_core`` (false for copies). A window over (entity, ``_block``) then sees
    everything within ``before``/``after`` rows of each core row.
    """
    size = rows or max(512, 4 * max(before, after, 1))
    if size < max(before, after):
        raise ValueError("a block must be at least as long as its halo")
    own = F.floor((F.col(idx) - 1) / size)
    pos = (F.col(idx) - 1) - own * size
    copies = F.array(
        own,
        F.when(pos >= size - before, own + 1),
        F.when((pos < after) & (own > 0), own - 1),
    )
    return (
        df.withColumn("_own", own)
        .withColumn("_block", F.explode(F.array_compact(copies)))
        .withColumn("_core", F.col("_own") == F.col("_block"))
        .drop("_own")
    )


def ranged_totals(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], weight: Column, name: str
) -> DataFrame:
    """Running total of ``weight`` per ``part`` in ``order``, for orders without a natural calendar.

    Rows are range-partitioned on (part, order), the range number is stored with a checkpoint (so it
    can never change on recomputation), totals of whole ranges are added up on a table of one row per
    (part, range), and only rows inside one range are ever sorted together.
    """
    part = list(part)
    placed = df.repartitionByRange(*[F.col(p) for p in part], *order).withColumn("_range", F.spark_partition_id())
    placed = cut_lineage(placed.withColumn("_w", weight))
    sums = placed.groupBy(*part, "_range").agg(F.sum("_w").alias("_m"))
    before = W.partitionBy(*part).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*part, "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy(*part, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.withColumn("_run", F.sum("_w").over(within))
        .join(sums, [*part, "_range"])
        .withColumn(name, (F.col("_run") + F.col("_before")).cast("bigint"))
        .drop("_range", "_w", "_run", "_before")
    )
