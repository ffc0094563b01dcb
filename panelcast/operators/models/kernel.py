"""Radial and polynomial models as linear models on mapped features."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.models.linear import COEF, fit, predict, solve_moments
from panelcast.operators.joins import join_groups
from panelcast.operators.moments import gram_matrix, gram_of_vector, listed, matrix, per_group


def fourier_map(xs: Sequence[str], sigma: float, size: int = 64, seed: int = 42) -> Column:
    """sqrt(2 / D) cos(w'x + c) with w ~ N(0, 2 sigma I): products approximate exp(-sigma |x - z|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * sigma), size=(len(xs), size))
    c = rng.uniform(0, 2 * np.pi, size)

    def z(x: pa.Array) -> pa.Array:
        m = matrix(x).reshape(-1, len(xs))
        return listed(np.sqrt(2.0 / size) * np.cos(m @ w + c))

    udf = F.arrow_udf(z, T.ArrayType(T.DoubleType()))
    return udf(F.array(*[F.col(x).cast("double") for x in xs]))


def kernel_ridge(
    df: DataFrame, y: str, xs: Sequence[str], sigma: float, lam: float, by: Sequence[str] = (), size: int = 64, seed: int = 42
) -> DataFrame:
    """Radial-kernel ridge regression per group on ``size`` random features (inputs on one scale)."""
    mapped = df.dropna(subset=[y, *xs]).select(
        *by, F.concat(fourier_map(xs, sigma, size, seed), F.array(F.col(y).cast("double"))).alias("_v")
    )

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        g = gram_matrix(cells, size + 2)
        return pd.DataFrame({"n": [int(g[0, 0])], "coef": [solve_moments(g, "ridge", {"lambda": lam}, [0.0] * (size + 1))]})

    return per_group(gram_of_vector(mapped, "_v", size + 1, by), by, solve, T.StructType([T.StructField("n", T.LongType()), COEF]))


def kernel_predict(
    df: DataFrame, models: DataFrame, xs: Sequence[str], sigma: float, by: Sequence[str] = (), size: int = 64, seed: int = 42,
    name: str = "prediction",
) -> DataFrame:
    joined = join_groups(df, models.select(*by, "coef"), by, size + 1) if by else df.withColumn("coef", models.select("coef").scalar())
    joined = joined.withColumn("_z", fourier_map(xs, sigma, size, seed))
    dot = F.aggregate(F.zip_with(F.slice("coef", 2, size), "_z", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn(name, F.col("coef")[0] + dot).drop("coef", "_z")


def polynomial_columns(xs: Sequence[str], degree: int, scale: float = 1.0) -> dict[str, Column]:
    """All monomials up to ``degree`` of the scaled predictors, as column expressions."""
    out: dict[str, Column] = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(xs, d):
            term = F.lit(float(scale**d))
            for x in combo:
                term = term * F.col(x)
            out["p_" + "_".join(combo)] = term
    return out


def poly_model(
    df: DataFrame, y: str, xs: Sequence[str], degree: int = 2, scale: float = 1.0, lam: float = 0.01, by: Sequence[str] = ()
) -> DataFrame:
    """Ridge on the monomials of a few selected features, per group."""
    terms = polynomial_columns(xs, degree, scale)
    return fit(df.select(*by, y, *[c.alias(n) for n, c in terms.items()]), y, list(terms), by, "ridge", {"lambda": lam})


def poly_predict(df: DataFrame, models: DataFrame, xs: Sequence[str], degree: int = 2, scale: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    terms = polynomial_columns(xs, degree, scale)
    return predict(df.withColumns(terms), models, list(terms), by).drop(*terms)
