"""Classical additive decomposition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.aggregate import mean_by
from panelcast.operators.frame import filter_in
from panelcast.operators.window import centered_mean


def panel_mean_series(panel: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Average over entities per day, as a panel of the one entity ``all``."""
    return mean_by(panel, [ts], value, value).select(F.lit("all").alias("entity"), ts, value)


def decompose(panel: DataFrame, period: int = 365, by: Sequence[str] = ("entity",), ts: str = "ts", value: str = "value") -> DataFrame:
    """trend (centred mean), seasonal (mean detrended value per phase, centred) and random part.

    The phase is (row number - 1) mod period over all days of a series. A series shorter than two
    periods has no complete seasonal figure and keeps nulls where it is undefined.
    """
    keys = list(by)
    t = centered_mean(panel, period, value, keys, ts, "trend", keep_index="idx")
    t = t.withColumn("phase", ((F.col("idx") - 1) % period).cast("int"))
    figure = t.groupBy(*keys, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_s"))
    level = figure.groupBy(*keys).agg(F.avg("_s").alias("_m"))
    figure = figure.join(level, keys).select(*keys, "phase", (F.col("_s") - F.col("_m")).alias("seasonal"))
    return (
        t.join(figure, [*keys, "phase"], "left")
        .withColumn("random", F.col(value) - F.col("trend") - F.col("seasonal"))
        .select(*keys, ts, value, "idx", "phase", "trend", "seasonal", "random")
    )


def trend_of(panel: DataFrame, entities, period: int = 365) -> DataFrame:
    """Trend component of chosen entities; the panel is cut to them first."""
    chosen = filter_in(panel, "entity", entities)
    return centered_mean(chosen, period).select("entity", "ts", "trend")
