"""Joins. A side is sent to all tasks only after its size was measured; else Spark splits skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def left_join_suffix(
    a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Left equi-join; non-key names on both sides get the suffixes."""
    clash = [c for c in a.columns if c in b.columns and c not in on]
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, list(on), "left")


def inner_join_named(a: DataFrame, b: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join on differently named keys; the left name stays."""
    return a.join(b.withColumnRenamed(right_key, left_key), left_key, "inner")


#: Numbers in a side up to which it is sent to every task.
SMALL = 1_000_000


def join_groups(df: DataFrame, side: DataFrame, on: Sequence[str], width: int = 1, how: str = "inner", numbers: int | None = None) -> DataFrame:
    """Join a table with one row per group (``width`` numbers each) to its rows.

    With few groups the rows stay where they are: ``side`` is stored, counted and broadcast (up to ``numbers``, else SMALL). A larger
    side is shuffled, and Spark splits the groups that are hot.
    """
    stored = cut_lineage(side)
    small = stored.count() * max(1, width) <= (SMALL if numbers is None else numbers)
    return df.join(F.broadcast(stored) if small else stored.hint("merge"), list(on), how)


def lookup_dim(df: DataFrame, dim: DataFrame, key: str = "entity") -> DataFrame:
    return df.join(dim, key, "left")


def merge_stats(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """n-way left join of per-key statistics."""
    return reduce(lambda x, y: x.join(y, key, "left"), tables)


def zip_by_key(a: DataFrame, b: DataFrame, key: str = "ts") -> DataFrame:
    """Put the columns of two frames side by side, matched by key and never by position."""
    return a.join(b, key, "inner")


def range_join_folds(df: DataFrame, folds: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows of every fold window: ``folds`` has ``fold, role, lo, hi`` in row-index units.

    Windows are opened to the index values they cover, so the range condition becomes an equi-join.
    """
    points = folds.select("fold", "role", F.explode(F.sequence("lo", "hi")).alias(idx))
    return df.join(points.withColumn(idx, F.col(idx).cast(df.schema[idx].dataType)), idx)
