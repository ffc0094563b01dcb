"""Time-aware splits and resampling, all as columns on the rows (never as row copies on the driver)."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ordering import date_index, join_dates


def chrono_split(indexed: DataFrame, train: float = 0.7, val: float = 0.15, idx: str = "idx") -> DataFrame:
    """``split`` = train / val / test by row index; sizes are rounded half to even."""
    n = F.max(idx).cast("double")
    sizes = indexed.agg(F.struct(F.bround(n * train, 0).alias("a"), F.bround(n * val, 0).alias("b")).alias("s")).scalar()
    return (
        indexed.withColumn("_s", sizes)
        .withColumn(
            "split",
            F.when(F.col(idx) <= F.col("_s.a"), "train")
            .when(F.col(idx) <= F.col("_s.a") + F.col("_s.b"), "val")
            .otherwise("test"),
        )
        .drop("_s")
    )


def split_by_date(df: DataFrame, train: float = 0.7, val: float = 0.15, ts: str = "ts") -> DataFrame:
    """``idx`` and ``split`` on every row; both are worked out on the table of dates and joined once."""
    return join_dates(df, chrono_split(date_index(df, ts), train, val), ts)


def holdout_index(indexed: DataFrame, train: float = 0.7, val: float = 0.15, offset: int = 0, idx: str = "idx") -> DataFrame:
    """The one fixed train/validation split as a fold table, shifted by the rows lost to lags."""
    n = F.max(idx).cast("double")
    a, b = F.bround(n * train, 0).cast("bigint"), F.bround(n * val, 0).cast("bigint")
    one = indexed.agg(a.alias("a"), b.alias("b"))
    windows = F.array(
        F.struct(F.lit(0).alias("fold"), F.lit("train").alias("role"), F.lit(1).cast("bigint").alias("lo"), (F.col("a") - offset).alias("hi")),
        F.struct(F.lit(0).alias("fold"), F.lit("val").alias("role"), (F.col("a") + 1 - offset).alias("lo"),
                 (F.col("a") + F.col("b") - offset).alias("hi")),
    )
    return one.select(F.inline(windows))


def time_slices(
    indexed: DataFrame, initial: int, horizon: int, skip: int = 0, fixed: bool = True, idx: str = "idx"
) -> DataFrame:
    """Rolling-origin folds ``(fold, role, lo, hi)``; a new origin every ``skip + 1`` rows."""
    step = skip + 1
    top = indexed.agg((F.max(idx) - horizon - initial).alias("_room"))
    stops = (
        top.where(F.col("_room") >= 0)
        .select(F.explode(F.sequence(F.lit(0), F.floor(F.col("_room") / step).cast("int"))).alias("fold"))
        .withColumn("stop", (F.lit(initial) + F.col("fold") * step).cast("bigint"))
    )
    one = F.lit(1).cast("bigint")
    windows = F.array(
        F.struct(F.lit("train").alias("role"), (F.col("stop") - initial + 1 if fixed else one).alias("lo"), F.col("stop").alias("hi")),
        F.struct(F.lit("test").alias("role"), (F.col("stop") + 1).alias("lo"), (F.col("stop") + horizon).alias("hi")),
    )
    return stops.select("fold", F.inline(windows))


def hash_uniform(keys: Sequence[str], *salt) -> Column:
    """Uniform [0, 1) from row keys: the same row gets the same draw on any number of executors."""
    h = F.xxhash64(*[F.col(k) for k in keys], *[F.lit(s) if not isinstance(s, Column) else s for s in salt])
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def repeated_kfold(df: DataFrame, keys: Sequence[str], k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """One copy of each row per repeat with its test fold 0..k-1."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "fold", F.floor(hash_uniform(keys, F.col("repeat"), seed) * k).cast("int")
    )


def bootstrap(df: DataFrame, keys: Sequence[str], replicates: int = 25, seed: int = 42) -> DataFrame:
    """Poisson(1) weight per (row, replicate); rows of weight 0 are left out of the replicate."""
    u = hash_uniform(keys, F.col("replicate"), seed)
    steps, p, total = [], 0.36787944117144233, 0.0
    for i in range(1, 20):
        total += p
        steps.append(total)
        p /= i
    weight = sum((F.when(u >= F.lit(s), 1).otherwise(0) for s in steps[1:]), F.when(u >= F.lit(steps[0]), 1).otherwise(0))
    return (
        df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("weight", weight)
        .where(F.col("weight") > 0)
    )


def random_search(space: Mapping[str, tuple[float, float]], n: int, seed: int = 42) -> list[dict[str, float]]:
    """n seeded draws; bounds that are both positive are drawn on a log scale."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        point = {}
        for name, (lo, hi) in space.items():
            point[name] = lo * (hi / lo) ** rng.random() if lo > 0 else rng.uniform(lo, hi)
        out.append(point)
    return out
