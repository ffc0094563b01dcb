"""Joins that broadcast a side only after its size was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows (or array cells) up to which a side is sent to every task.
BROADCAST_CELLS = 100_000


def small_left_join(df: DataFrame, side: DataFrame, on: Column, cells: Column | None = None, limit: int = BROADCAST_CELLS) -> DataFrame:
    """``df`` left join ``side``: broadcast if ``side`` has at most ``limit`` cells, else a shuffled join that Spark splits where a key is hot."""
    size = side.agg(F.sum(F.lit(1) if cells is None else cells).alias("n")).first()["n"] or 0
    return df.join(F.broadcast(side) if size <= limit else side.hint("merge"), on, "left")
