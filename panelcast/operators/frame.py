"""Projection, renaming, filters, slices and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def select_block(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _require(df, names)
    return df.select(*names)


def drop_block(df: DataFrame, names: Sequence[str], strict: bool = True) -> DataFrame:
    if strict:
        _require(df, names)
    return df.drop(*names)


def column_blocks(columns: Sequence[str], targets: slice, predictors: slice) -> dict[str, list[str]]:
    """Split an ordered name list into targets, predictors and everything else."""
    cols = list(columns)
    t, p = cols[targets], cols[predictors]
    return {"targets": t, "predictors": p, "others": column_difference(cols, t + p)}


def column_difference(a: Sequence[str], b: Sequence[str]) -> list[str]:
    gone = set(b)
    return [c for c in a if c not in gone]


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    _require(df, list(mapping))
    return df.withColumnsRenamed(dict(mapping))


def suffix_columns(df: DataFrame, prefix: str, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c.startswith(prefix)})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def rescale(df: DataFrame, col: str, unit: float = 1e6) -> DataFrame:
    return df.withColumn(col, F.col(col) / F.lit(unit))


def with_order(df: DataFrame, ranking: DataFrame, key: str = "entity", order: str = "rank") -> DataFrame:
    """Attach the position of ``key`` in another ranking (null when it is not ranked)."""
    return df.join(ranking.select(key, F.col(order).alias("order")), key, "left")


def filter_in(df: DataFrame, col: str, members) -> DataFrame:
    """Membership: literals become ``isin``, a DataFrame (first column) becomes a left-semi join."""
    if isinstance(members, DataFrame):
        keys = members.select(F.col(members.columns[0]).alias(col))
        return df.join(keys, col, "left_semi")
    return df.filter(F.col(col).isin(list(members)))


def filter_between(df: DataFrame, col: str, lo, hi) -> DataFrame:
    return df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))


def filter_latest_year(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of the year of the latest date, by scalar subquery."""
    return df.filter(F.year(ts) == df.select(F.year(F.max(ts))).scalar())


def slice_rows(indexed: DataFrame, lo: int, hi: int | None = None, idx: str = "idx") -> DataFrame:
    """Rows lo..hi (1-based, closed) of a frame that carries a row index."""
    cond = F.col(idx) >= lo
    return indexed.filter(cond if hi is None else cond & (F.col(idx) <= hi))


def drop_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def head_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def threshold_flag(df: DataFrame, col: str, t: float, name: str = "flag", below: bool = False) -> DataFrame:
    """``|col| >= t``, or ``col <= t`` with ``below``."""
    return df.withColumn(name, F.col(col) <= t if below else F.abs(F.col(col)) >= t)


def stack_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
