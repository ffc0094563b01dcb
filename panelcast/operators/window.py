"""Lags, centred means, z-scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.joins import join_groups
from panelcast.operators.ordering import entity_index, with_halo


def add_lags(
    df: DataFrame,
    step: int = 30,
    times: int = 5,
    col: str = "value",
    entity: Sequence[str] = ("entity",),
    ts: str = "ts",
    drop_head: bool = True,
) -> DataFrame:
    """``<col>_lag_<step*i>`` for i = 1..times in row order per entity; the first step*times rows go."""
    keys, depth = list(entity), step * times
    indexed = entity_index(df, keys, ts, "_idx")
    w = W.partitionBy(*keys, "_block").orderBy("_idx")
    out = (
        with_halo(indexed, "_idx", before=depth, after=0)
        .withColumns({f"{col}_lag_{step * i}": F.lag(col, step * i).over(w) for i in range(1, times + 1)})
        .where("_core")
    )
    if drop_head:
        out = out.where(F.col("_idx") > depth)
    return out.drop("_idx", "_block", "_core")


def lag_names(step: int = 30, times: int = 5, col: str = "value") -> list[str]:
    return [f"{col}_lag_{step * i}" for i in range(1, times + 1)]


def centered_mean(
    df: DataFrame, width: int, col: str = "value", entity: Sequence[str] = ("entity",), ts: str = "ts", name: str = "trend",
    keep_index: str | None = None,
) -> DataFrame:
    """Symmetric moving average; null where the window is incomplete; even widths halve the end weights."""
    keys, half = list(entity), width // 2
    idx = keep_index or "_idx"
    indexed = entity_index(df, keys, ts, idx)
    blocks = with_halo(indexed, idx, before=half, after=half)
    w = W.partitionBy(*keys, "_block").orderBy(idx)
    span = w.rowsBetween(-half, half)
    total = F.sum(col).over(span)
    if width % 2 == 0:
        total = total - (F.lag(col, half).over(w) + F.lead(col, half).over(w)) / 2
    mean = F.when(F.count(col).over(span) == 2 * half + 1, total / width)
    out = blocks.withColumn(name, mean).where("_core").drop("_block", "_core")
    return out if keep_index else out.drop(idx)


def zscore(df: DataFrame, col: str = "value", part: Sequence[str] = (), name: str = "z") -> DataFrame:
    """(x - mean) / sd with the sample sd, per part or over the whole column."""
    stats = [F.avg(col).alias("_mean"), F.stddev_samp(col).alias("_sd")]
    if part:
        joined = join_groups(df, df.groupBy(*part).agg(*stats), part, 2)
    else:
        one = df.agg(*stats).select(F.struct("_mean", "_sd")).scalar()
        joined = df.withColumn("_s", one).select("*", "_s.*").drop("_s")
    z = (F.col(col) - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))
    return joined.withColumn(name, z).drop("_mean", "_sd")
