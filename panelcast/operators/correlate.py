"""Correlation, its significance and its distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.student import t_pvalue
from panelcast.operators.distribution import histogram
from panelcast.operators.frame import filter_in
from panelcast.operators.moments import pair_moments
from panelcast.operators.rank import top_k


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r and the number of complete pairs for i <= j: ``i, j, a, b, n, r``."""
    names = F.array(*[F.lit(c) for c in cols])
    n = F.nullif(F.col("n"), F.lit(0))  # a pair that never occurs together has no r
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((n > 1) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    return pair_moments(df, cols).select(
        "i", "j", F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "n",
        F.when(F.col("i") == F.col("j"), F.when(vx > 0, F.lit(1.0))).otherwise(r).alias("r"),
    )


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """Both triangles of a matrix given by its pairs i <= j."""
    flipped = pairs.where("i < j").select(F.col("b").alias("a"), F.col("a").alias("b"), value)
    return pairs.select("a", "b", value).union(flipped)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return symmetric(correlation_pairs(df, cols), "r")


def with_pvalues(pairs: DataFrame) -> DataFrame:
    """Adds t = r sqrt((n-2)/(1-r^2)) and its two-sided p-value (0 on the diagonal)."""
    dof = (F.col("n") - 2).cast("double")
    t = F.when(
        (F.col("i") < F.col("j")) & (dof > 0),
        F.when(F.abs("r") < 1, F.col("r") * F.sqrt(dof / (1 - F.col("r") * F.col("r")))).otherwise(
            F.signum("r") * F.lit(float("inf"))
        ),
    )
    return pairs.withColumn("t", t).withColumn(
        "p", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.nanvl(t_pvalue("t", dof), F.lit(None).cast("double")))
    )


def correlation_pvalues(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return symmetric(with_pvalues(correlation_pairs(df, cols)), "p")


def significant_pairs(df: DataFrame, cols: Sequence[str], level: float = 0.01) -> DataFrame:
    """Upper triangle without the insignificant pairs."""
    tested = with_pvalues(correlation_pairs(df, cols).where("i < j"))
    return tested.where(F.col("p") <= level).select("a", "b", "n", "r", "p")


def cross_correlation(panel: DataFrame, features: DataFrame, predictors: Sequence[str], k: int = 5) -> DataFrame:
    """The k entities with the largest totals against the predictors, matched by date."""
    best = filter_in(panel, "entity", top_k(panel, k).select("entity"))
    joined = best.join(features.select("ts", *predictors), "ts")
    wide = joined.groupBy("entity").agg(*[F.corr("value", p).alias(p) for p in predictors])
    return wide.unpivot(["entity"], list(predictors), "feature", "r")


def correlation_histogram(matrix: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(matrix, "r", bins)
