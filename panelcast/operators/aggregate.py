"""Grouped statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import year_month
from panelcast.operators.frame import filter_latest_year
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.reshape import to_long

QUARTILES = [0.25, 0.5, 0.75]
#: Rows whose groups a task holds.
GROUP_ROWS = 500_000


def in_even_parts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` dealt by ``by``, in more parts than the session names if those would hold more than GROUP_ROWS rows each.

    For groups nearly as many as the rows: the tables of groups in a task then keep their size however many rows
    there are, and so do those of later steps by the same columns. Counting a stored table reads no rows.
    """
    parts = -(-df.count() // GROUP_ROWS)
    return df.repartition(parts, *by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def total_by(df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias(name))


def mean_by(df: DataFrame, keys: Sequence[str], value: str = "value", name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name))


def entity_profile(panel: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value") -> DataFrame:
    """mean, sd, quartiles, max, min, first and last value per entity."""
    moments = panel.groupBy(entity).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.min_by(value, ts).alias("first"),
        F.max_by(value, ts).alias("last"),
    )
    q = exact_quantiles(panel, [entity], value, QUARTILES, ["q25", "q50", "q75"])
    return moments.join(q, entity).select(
        entity, "mean", "sd", "q25", "q50", "q75", "max", "min", "first", "last"
    )


def entity_profile_latest_year(panel: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value") -> DataFrame:
    out = entity_profile(filter_latest_year(panel, ts), entity, ts, value).drop("last")
    return out.withColumnsRenamed({c: f"{c}_last_year" for c in out.columns if c != entity})


def last_value_by(panel: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value") -> DataFrame:
    return panel.groupBy(entity).agg(F.max_by(value, ts).alias("last"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, sd ignoring nulls, and null share, one row per column."""
    long = to_long(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "variable", "value")
    stats = long.groupBy("variable").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        (F.count_if(F.col("value").isNull()) / F.count("*")).alias("null_share"),
    )
    med = exact_quantiles(long, ["variable"], "value", [0.5], ["median"])
    return stats.join(med, "variable", "left").select("variable", "mean", "median", "sd", "null_share")


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def period_rollup(panel: DataFrame, keys: Sequence[str] = ("entity",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Monthly sums in millions, rounded half to even."""
    return panel.groupBy(*keys, year_month(ts).alias("period")).agg(
        F.bround(F.sum(value) / F.lit(1e6), 0).alias("value")
    )


def distinct_count(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column; null counts as one value."""
    count = F.approx_count_distinct if approx else F.count_distinct
    one = df.agg(
        *[(count(c) + F.max(F.col(c).isNull().cast("int"))).cast("bigint").alias(c) for c in cols]
    )
    return one.unpivot([], list(cols), "variable", "n_distinct")
