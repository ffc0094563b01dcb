"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one row in this many; so there are at most this many hot keys.
HOT = 1000


def hot_join(df: DataFrame, side: DataFrame, key: str, rows: str, total: int, how: str = "inner") -> DataFrame:
    """``df`` join ``side`` (one row a key) on ``key``, without a hot key in one task.

    ``rows`` is a column of ``side``: at least as many as the key has rows in ``df``; these numbers add
    up to at most ``total``. Keys with a share of 1 / HOT or more are therefore at most HOT, whatever
    the input, and are sent to the tasks; the others are shuffled, none with a larger share.
    ``how`` is inner or left. ``df`` is read twice and should be stored.
    """
    often = F.col(rows) * HOT >= F.lit(total)
    hot = F.broadcast(side.where(often))
    rest = side.where(~often)
    rare = df.join(hot.select(key), key, "left_anti")
    return df.join(hot, key).unionByName(rare.hint("merge").join(rest.hint("merge"), key, how))
