"""Groups of rows that reach a task in key order, and columns of vectors as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal (non-null, integer) keys in a sorted stream, as tables; only one run and one batch are held."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        change = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield table.slice(s, e - s)
        rest = table.slice(cuts[-1]).to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose rows have one length, as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def listed(rows: np.ndarray) -> pa.ListArray:
    """The reverse of ``matrix``."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows).ravel()))


def usable(vec: Column) -> Column:
    """True for a vector that is not null, empty or zero and holds neither nulls nor non-finite numbers."""
    finite = F.forall(vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, h1, h2): usable vectors, with a 128-bit key of their content."""
    kind = "array<float>" if dict(df.dtypes)[vec_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("vec")).where(usable(F.col("vec")))
    return rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
