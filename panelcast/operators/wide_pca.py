"""Principal components of thousands of columns, by a randomised range finder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns looked for beyond those wanted.
EXTRA = 10


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``part`` over the batches of vectors; tasks hand on one array, and arrays are added up along rows of the array, so the driver gets one."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
        flat = total.reshape(shape[0], -1)
        for at in range(0, len(flat), 256):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([flat[at : at + 256].tobytes()], pa.binary())], ["at", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for at, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])
                    now, total = at, np.zeros(len(sums) // 8)
                total += np.frombuffer(sums, dtype=float)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["at", "sums"])

    parts = rows.mapInArrow(partial, "at int, sums binary").repartition("at").sortWithinPartitions("at").mapInArrow(added, "at int, sums binary")
    out = [np.frombuffer(r["sums"], dtype=float) for r in sorted(parts.collect(), key=lambda r: r["at"])]
    return np.concatenate(out).reshape(shape) if out else np.zeros(shape)


@dataclass(frozen=True)
class WidePca:
    """Standardisation and the first components of a vector column."""

    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray  # (columns, components)
    explained: np.ndarray  # variance share of each component

    @staticmethod
    def fit(df: DataFrame, vec: str, components: int, power: int = 2, seed: int = 42) -> WidePca:
        """The first ``components`` of a column of equally long vectors (rows with nulls or NaN take no part).

        Random directions are sent through C'C (C: standardised rows) ``power`` + 1 times, each time one pass by batches of rows;
        their span holds the leading components, which a last pass finds in it exactly. The driver holds
        columns x (components + EXTRA) numbers, never columns x columns. Shares are those of the total variance.
        """
        rows = df.select(F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        first = rows.select(F.size("v").alias("p")).first()
        if first is None:
            raise ValueError(f"{vec} has no whole vector")
        p = first["p"]
        start = _added(rows, lambda x: np.stack([np.full(p, float(len(x))), x.sum(axis=0)], axis=1), (p, 2))
        n = start[0, 0]
        mean = start[:, 1] / n
        var = _added(rows, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], (p, 1))[:, 0] / max(n - 1, 1)
        sd = np.where(var > 0, np.sqrt(var), 1.0)
        width = min(p, components + EXTRA)
        q = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))[0]

        def through(x: np.ndarray, q: np.ndarray) -> np.ndarray:
            c = (x - mean) / sd
            return c.T @ (c @ q)

        for _ in range(power + 1 if width < p else 1):
            q = np.linalg.qr(_added(rows, lambda x, q=q: through(x, q), (p, width)))[0]

        def inside(x: np.ndarray) -> np.ndarray:
            c = (x - mean) / sd @ q
            return c.T @ c

        values, vectors = np.linalg.eigh(_added(rows, inside, (width, width)) / max(n - 1, 1))
        order = np.argsort(-values)[:components]
        kept = q @ vectors[:, order]
        kept = kept * np.sign(kept[np.abs(kept).argmax(axis=0), np.arange(kept.shape[1])])  # largest loading positive
        return WidePca(mean, sd, kept, np.clip(values[order], 0, None) / max(float((var > 0).sum()), 1.0))

    def transform(self, df: DataFrame, vec: str, name: str = "scores") -> DataFrame:
        """``df`` with the array of a vector's scores; null where it has gaps."""
        shared = df.sparkSession.sparkContext.broadcast((self.mean, self.sd, self.loadings))

        def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mean, sd, loadings = shared.value
            for v in parts:
                known = v.notna()
                out = pd.Series([None] * len(v), dtype=object)
                if known.any():
                    x = np.vstack(v[known].to_numpy()).astype(float)
                    out[known.to_numpy()] = pd.Series(list((x - mean) / sd @ loadings), index=np.flatnonzero(known.to_numpy()))
                yield out

        whole = F.when(~F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x.cast("double"))), F.col(vec).cast("array<double>"))
        return df.withColumn(name, F.pandas_udf(scores, "array<double>")(whole))
