"""One-pass second moments: the shared core of correlation, PCA and all linear models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NARROW = 10  # up to here the sums are plain JVM aggregates
CELL_BUDGET = 4_000_000  # partial sums held per task before they are handed on


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as rows; null elements are NaN."""
    if not len(column):
        return np.zeros((0, 1))
    sizes = pc.list_value_length(column)
    if column.null_count or pc.min(sizes) != pc.max(sizes):
        raise ValueError("vectors are null or differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def listed(rows: np.ndarray) -> pa.ListArray:
    """The reverse of ``matrix``: NaN is null again."""
    n, d = rows.shape
    flat = np.ascontiguousarray(rows).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(flat, mask=np.isnan(flat)))


def plain(value):
    """A key as ``collect`` gives it: instants without a zone."""
    return value.astimezone().replace(tzinfo=None) if isinstance(value, datetime) and value.tzinfo else value


def key_groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[dict, np.ndarray]]:
    """(key by name, places) of each group of rows of a batch."""
    if not batch.num_rows:
        return
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy()
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield {k: batch.column(k)[int(at[0])].as_py() for k in keys}, at


def column_means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Column means as driver numbers (one per column); used to shift data before squaring it."""
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    row = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(known)]).first()
    return [float(v) if v is not None else 0.0 for v in row]


def gram(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), shift: Sequence[float] | None = None, weight: str | None = None
) -> DataFrame:
    """Sums of products of ``[1, cols...]`` over rows without nulls: rows ``(by..., i, j, s)``, i <= j.

    Index 0 is the constant, so (0, 0) is the row count (or the weight) and (0, j) the column sums.
    Few columns: JVM aggregates with map-side combine. Many columns: matrix products per Arrow batch,
    kept as partial sums per group and task, then summed; a group of any size is never gathered.
    """
    by, cols = list(by), list(cols)
    shift = [0.0] * len(cols) if shift is None else [float(s) for s in shift]
    x = [F.col(c).cast("double") - F.lit(s) if s else F.col(c).cast("double") for c, s in zip(cols, shift)]
    w = [F.col(weight).cast("double").alias("_w")] if weight else []
    if len(cols) > NARROW:
        return _gram_wide(df.select(*by, *w, F.array(*x).alias("_x")), by, len(cols), weight)
    data = df.select(*by, *w, *[c.alias(f"_{k + 1}") for k, c in enumerate(x)])
    return _gram_narrow(data.dropna(subset=[f"_{k + 1}" for k in range(len(cols))]), by, len(cols), weight)


def gram_of_vector(df: DataFrame, vec: str, size: int, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """The same for an array<double> column of ``size`` elements."""
    w = [F.col(weight).cast("double").alias("_w")] if weight else []
    return _gram_wide(df.select(*by, *w, F.col(vec).alias("_x")), list(by), size, weight)


def _gram_narrow(data: DataFrame, by: list[str], p: int, weight) -> DataFrame:
    one = F.col("_w") if weight else F.lit(1.0)
    x = [one, *[F.col(f"_{k}") * one if weight else F.col(f"_{k}") for k in range(1, p + 1)]]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = [
        F.sum(x[j] if i == 0 else x[i] * F.col(f"_{j}")).alias(f"s_{i}_{j}") for i, j in pairs
    ]
    wide = data.groupBy(*by).agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s_{i}_{j}").alias("s")) for i, j in pairs])
    return wide.select(*by, F.inline(cells)).where(F.col("s").isNotNull())


def _gram_wide(data: DataFrame, by: list[str], p: int, weight) -> DataFrame:
    schema = T.StructType(
        [data.schema[b] for b in by] + [T.StructField("i", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))]
    )
    keep = max(1, CELL_BUDGET // ((p + 1) ** 2))

    def rows(held: dict, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, m in held.items():
            out = [pa.array([v] * (p + 1), kinds.field(b).type) for b, v in zip(by, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.arange(p + 1, dtype="int32")), pa.array(list(m), pa.list_(pa.float64()))], [*by, "i", "row"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x = matrix(batch.column("_x"))
            whole = ~np.isnan(x).any(axis=1)
            w = batch.column("_w").to_numpy(zero_copy_only=False).astype(float) if weight else None
            for group, at in key_groups(batch, by):
                key, at = tuple(group.values()), at[whole[at]]
                if not len(at):
                    continue
                g = np.column_stack([np.ones(len(at)), x[at]])
                m = (g * w[at, None]).T @ g if weight else g.T @ g
                held[key] = held[key] + m if key in held else m
                if len(held) >= keep:
                    yield from rows(held, batch.schema)
                    held = {}
        if held:
            yield from rows(held, batch.schema)

    parts = data.mapInArrow(partial, schema)
    cells = parts.select(*by, "i", F.posexplode("row").alias("j", "s")).where(F.col("j") >= F.col("i"))
    return cells.groupBy(*by, "i", "j").agg(F.sum("s").alias("s"))


def gram_matrix(cells: pd.DataFrame, size: int) -> np.ndarray:
    """Symmetric matrix from the ``i, j, s`` rows of one group."""
    g = np.zeros((size, size))
    i, j, s = cells["i"].to_numpy(), cells["j"].to_numpy(), cells["s"].to_numpy(dtype=float)
    g[i, j] = s
    g[j, i] = s
    return g


def per_group(cells: DataFrame, by: Sequence[str], solve, schema: T.StructType) -> DataFrame:
    """Run ``solve(cells) -> DataFrame`` on the Gram rows of each group; p^2 rows, whatever the data size.

    ``schema`` describes the solver's own columns; the group keys are put in front.
    """
    by = list(by)
    keys = by or ["_g"]
    src = cells if by else cells.withColumn("_g", F.lit(0))
    full = T.StructType([src.schema[k] for k in keys] + list(schema.fields))
    out_names = [f.name for f in full.fields]

    cell_names = [c for c in src.columns if c not in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for n, packed in enumerate(pdf["_cells"]):
                cells = pd.DataFrame([c if isinstance(c, dict) else c.asDict() for c in packed], columns=cell_names)
                for k in keys:
                    cells[k] = [pdf[k].iloc[n]] * len(cells)
                out = solve(cells)
                for k in keys:
                    out[k] = [pdf[k].iloc[n]] * len(out)
                done.append(out[out_names])
            if done:
                yield pd.concat(done, ignore_index=True)

    # one short row per group; the solvers are not free, so every shuffle partition is kept
    parts = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = src.groupBy(*keys).agg(F.collect_list(F.struct(*cell_names)).alias("_cells"))
    out = rows.repartition(parts, *keys).mapInPandas(run, full)
    return out if by else out.drop("_g")


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n and the sums of x, y, xx, yy, xy for every pair i <= j over rows where both are present."""
    cols = list(cols)
    p, shift = len(cols), np.array(column_means(df, cols))
    data = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(cols)])
    up = np.triu_indices(p)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((6, p, p))
        seen = False
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            ok = ~np.isnan(x)
            x, m = np.where(ok, x, 0.0), ok.astype(float)
            sx, sxx = x.T @ m, (x * x).T @ m
            acc += np.stack([m.T @ m, sx, sx.T, sxx, sxx.T, x.T @ x])
            seen = True
        if seen:
            yield pd.DataFrame(
                {"i": up[0].astype("int32"), "j": up[1].astype("int32"),
                 **{name: acc[k][up] for k, name in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}}
            )

    parts = data.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return parts.groupBy("i", "j").agg(
        F.sum("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in ("sx", "sy", "sxx", "syy", "sxy")]
    )
