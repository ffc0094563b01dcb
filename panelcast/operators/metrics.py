"""Errors of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.distribution import histogram


def regression_metrics(df: DataFrame, truth: str = "value", pred: str = "prediction", by: Sequence[str] = ("entity", "split")) -> DataFrame:
    """n, MSE, RMSE and MAE per group; error = prediction - truth."""
    e = F.col(pred) - F.col(truth)
    return df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def split_metrics(df: DataFrame, truth: str = "value", pred: str = "prediction", by: Sequence[str] = ("entity",), split: str = "split") -> DataFrame:
    """One row per group: MSE and MAE of train, val, train+val and test, in one aggregate."""
    e = F.col(pred) - F.col(truth)
    parts = {"train": F.col(split) == "train", "val": F.col(split) == "val",
             "train_val": F.col(split).isin("train", "val"), "test": F.col(split) == "test"}
    return df.groupBy(*by).agg(
        *[F.avg(F.when(c, e * e)).alias(f"mse_{n}") for n, c in parts.items()],
        *[F.avg(F.when(c, F.abs(e))).alias(f"mae_{n}") for n, c in parts.items()],
    )


def fit_label(ratio: Column) -> Column:
    """Labels in their original order, so that a ratio of 0 is already 'Underfitting'."""
    return F.when(ratio < 1, "Underfitting").when(ratio == 0, "Fit").when(ratio.isNotNull(), "Overfitting")


def fit_diagnosis(metrics: DataFrame, fitted: str = "mae_train_val", evaluated: str = "mae_test") -> DataFrame:
    ratio = F.col(evaluated) / F.nullif(F.col(fitted), F.lit(0.0))
    return metrics.withColumn("mae_ratio", ratio).withColumn("fitting", fit_label(F.col("mae_ratio")))


def collect_results(diagnosed: DataFrame, bins: int = 10) -> DataFrame:
    """Histogram of the error ratio by label over all entities."""
    return histogram(diagnosed, "mae_ratio", bins, ["fitting"])


def predicted_vs_actual(df: DataFrame, keys: Sequence[str] = ("entity", "ts"), truth: str = "value", pred: str = "prediction") -> DataFrame:
    return df.select(*keys, F.col(pred).alias("prediction"), F.col(truth).alias("actual"))
