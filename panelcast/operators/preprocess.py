"""Scaling and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.distribution import boxplot_stats, histogram
from panelcast.operators.joins import zip_by_key
from panelcast.operators.moments import column_means, gram, gram_matrix
from panelcast.operators.reshape import to_long


@dataclass(frozen=True)
class Scaler:
    """Centre and scale fitted on one table (two numbers per column) and applied to any other.

    Columns that were not fitted pass through; a constant column is only centred.
    """

    mean: dict[str, float]
    sd: dict[str, float]

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str]) -> "Scaler":
        row = df.agg(
            *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
            *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        ).first()
        return Scaler(
            {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(cols)},
            {c: float(row[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(cols)},
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.sd[c]) for c, m in self.mean.items()})


@dataclass(frozen=True)
class PCAThreshold:
    """Standardise, keep the fewest components that reach the variance share ``thresh``."""

    cols: list[str]
    mean: np.ndarray
    sd: np.ndarray
    loadings: np.ndarray  # columns = kept components
    explained: np.ndarray  # variance share of every component

    @staticmethod
    def fit(df: DataFrame, cols: Sequence[str], thresh: float = 0.9, k: int | None = None) -> "PCAThreshold":
        cols = list(cols)
        shift = column_means(df, cols)
        g = gram_matrix(gram(df, cols, shift=shift).toPandas(), len(cols) + 1)  # p x p numbers
        n = g[0, 0]
        mean = g[0, 1:] / n
        cov = (g[1:, 1:] / n - np.outer(mean, mean)) * n / (n - 1)
        sd = np.sqrt(np.diag(cov))
        sd = np.where(sd > 0, sd, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
        order = np.argsort(-values)
        values, vectors = np.clip(values[order], 0, None), vectors[:, order]
        share = values / values.sum()
        keep = k or int(np.searchsorted(np.cumsum(share), thresh - 1e-12) + 1)
        kept = vectors[:, : min(keep, len(cols))]
        kept = kept * np.sign(kept[np.abs(kept).argmax(axis=0), np.arange(kept.shape[1])])  # largest loading positive
        return PCAThreshold(cols, mean + np.asarray(shift), sd, kept, share)

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.loadings.shape[1])]

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns plus the component scores."""
        mean, sd, load = self.mean, self.sd, self.loadings

        def scores(x: pd.Series) -> pd.Series:
            m = np.vstack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, len(mean)))
            return pd.Series(list(((m - mean) / sd) @ load))

        udf = F.pandas_udf(scores, T.ArrayType(T.DoubleType()))
        vec = F.array(*[F.col(c).cast("double") for c in self.cols])
        wide = df.select(*keep, udf(vec).alias("_s"))
        return wide.select(*keep, *[F.col("_s")[i].alias(n) for i, n in enumerate(self.names)])


def pca_scores_table(dates: DataFrame, pca: PCAThreshold, df: DataFrame, ts: str = "ts") -> DataFrame:
    """Date columns next to the component scores."""
    return zip_by_key(dates, pca.transform(df, [ts]), ts)


def pca_distributions(scores: DataFrame, names: Sequence[str], bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """Histogram and box-plot tables per component."""
    long = to_long(scores, [], names, "component", "value")
    return histogram(long, "value", bins, ["component"]), boxplot_stats(long, "value", ["component"])
