"""Smooth curve of a value against the date."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.joins import join_groups
from panelcast.operators.models.linear import fit, linear_score
from panelcast.operators.moments import per_group
from panelcast.session import scratch_path


def _basis(ts: str, lo: Column, hi: Column, knots: int) -> dict[str, Column]:
    """Cubic spline basis on [0, 1] with equally spaced inner knots."""
    t = (F.unix_date(ts) - lo) / F.nullif(hi - lo, F.lit(0)).cast("double")
    out = {"b1": t, "b2": t * t, "b3": t * t * t}
    for k in range(1, knots + 1):
        d = F.greatest(F.lit(0.0), t - F.lit(k / (knots + 1)))
        out[f"k{k}"] = d * d * d
    return out


#: Numbers of curves up to which all are sent to every task.
CURVE_NUMBERS = 4_000_000


def smooth_trend(panel: DataFrame, knots: int = 5, by: Sequence[str] = ("entity",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Cubic-spline least squares per group, evaluated on the dates of the group.

    The rows are worked out and shuffled once and stored with the rows of a group side by side: the many sums of a group
    are then added up where its rows lie, and the later passes read three columns.
    """
    by, spark = list(by), panel.sparkSession
    path = scratch_path(spark, "trend")
    kept = panel.select(*by, ts, value)
    kept.repartitionByRange(*by, ts).write.parquet(path)
    rows = spark.read.schema(kept.schema).parquet(path)
    lo, hi = (F.lit(v).cast("int") for v in rows.agg(F.unix_date(F.min(ts)), F.unix_date(F.max(ts))).first())
    basis = _basis(ts, lo, hi, knots)
    models = fit(rows.withColumns(basis), value, list(basis), by)
    if by:
        joined = join_groups(rows, models.select(*by, "coef"), by, len(basis) + 1, numbers=CURVE_NUMBERS)
    else:
        joined = rows.withColumn("coef", models.select("coef").scalar())
    return joined.withColumns(basis).select(*by, ts, value, linear_score("coef", list(basis)).alias("smooth"))


def binned_trend(panel: DataFrame, days: int = 30, by: Sequence[str] = ("entity",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per stretch of ``days`` days since 1970-01-01."""
    return panel.groupBy(*by, F.floor(F.unix_date(ts) / days).cast("int").alias("bin")).agg(
        F.avg(value).alias("smooth"), F.count("*").alias("n")
    )


#: Smoothness values to choose from.
LAMBDAS = tuple(10.0**k for k in range(-4, 9))


def _bsplines(u: Column) -> list[Column]:
    """The four cubic B-splines that are not zero at place ``u`` (0 to 1) between two knots."""
    v = 1 - u
    return [v * v * v / 6, (3 * u * u * u - 6 * u * u + 4) / 6, (-3 * u * u * u + 3 * u * u + 3 * u + 1) / 6, u * u * u / 6]


def _placed(panel: DataFrame, knots: int, ts: str) -> DataFrame:
    """``panel`` with the stretch ``_seg`` between knots a date lies in and its four basis values; knots are even from the first to the last date."""
    day = F.unix_date(F.to_date(ts))
    ends = panel.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("e")).scalar()
    t = (day - F.col("_e.lo")) / F.nullif((F.col("_e.hi") - F.col("_e.lo")).cast("double"), F.lit(0.0)) * knots
    placed = panel.withColumn("_e", ends).withColumn("_t", F.coalesce(t, F.lit(0.0)))
    placed = placed.withColumn("_seg", F.least(F.floor("_t").cast("int"), F.lit(knots - 1)))
    return placed.withColumns({f"_b{i}": b for i, b in enumerate(_bsplines(F.col("_t") - F.col("_seg")))}).drop("_e", "_t")


def penalised_trend(
    panel: DataFrame, knots: int = 20, by: Sequence[str] = ("entity",), ts: str = "ts", value: str = "value", lambdas: Sequence[float] = LAMBDAS,
) -> DataFrame:
    """``panel`` keys with value, ``smooth`` and the ``lambda`` chosen for the group: penalised cubic B-splines.

    Minimises the squared error plus lambda times the squared second differences of the coefficients; lambda
    has the least generalised cross-validation score n RSS / (n - tr H)^2 of ``lambdas`` (the first of equal ones). One pass: a row
    touches four basis functions, so each (group, stretch) has 16 sums, and a group's banded normal equations are
    put together from its ``knots`` stretches. Rows without value or date are smoothed but not counted; a group
    without values has no curve (null). Large lambdas lead to the straight line of least squares.
    """
    by, size = list(by), knots + 3
    placed = _placed(panel.select(*by, ts, value), knots, ts)
    known = placed.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col("_seg").isNotNull())
    y, cells = F.col(value).cast("double"), [(i, j) for i in range(4) for j in range(i, 4)]
    sums = known.groupBy(*by, "_seg").agg(
        F.count("*").cast("double").alias("n"), F.sum(y * y).alias("yy"), F.array(*[F.sum(F.col(f"_b{i}") * y) for i in range(4)]).alias("by"),
        F.array(*[F.sum(F.col(f"_b{i}") * F.col(f"_b{j}")) for i, j in cells]).alias("bb"),
    )
    bend = np.diff(np.eye(size), 2, axis=0)

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        a, c, n, yy = np.zeros((size, size)), np.zeros(size), float(parts["n"].sum()), float(parts["yy"].sum())
        for seg, b, bb in zip(parts["_seg"], parts["by"], parts["bb"], strict=True):
            c[seg : seg + 4] += b
            for (i, j), v in zip(cells, bb, strict=True):
                a[seg + i, seg + j] += v
                a[seg + j, seg + i] += v if i != j else 0.0
        # a = half' half: least squares on the root of the moments stays exact under large penalties
        values, vectors = np.linalg.eigh(a)
        root = np.sqrt(np.where(values > 1e-13 * values[-1], values, 0.0))
        half = root[:, None] * vectors.T
        target = np.concatenate([np.divide(vectors.T @ c, root, out=np.zeros(size), where=root > 0), np.zeros(len(bend))])
        best = None
        for lam in lambdas:
            u, s, v = np.linalg.svd(np.concatenate([half, np.sqrt(lam) * bend]), full_matrices=False)
            live = s > 1e-13 * s[0]  # a basis function without rows is held by the penalty alone
            coef = v[live].T @ (u[:, live].T @ target / s[live])
            freedom = n - float((u[:size, live] ** 2).sum())
            rss = max(yy - 2 * coef @ c + coef @ a @ coef, 0.0)
            score = n * rss / freedom**2 if freedom > 1e-6 else np.inf
            if best is None or score < best[0] * (1 - 1e-9):
                best = (score, lam, coef)
        return pd.DataFrame({"lambda": [best[1]], "_coef": [best[2]]})

    fields = T.StructType([T.StructField("lambda", T.DoubleType()), T.StructField("_coef", T.ArrayType(T.DoubleType()))])
    curves = per_group(sums, by, solve, fields)
    joined = join_groups(placed, curves, by, size, "left") if by else placed.withColumn("_m", curves.select(F.struct("lambda", "_coef")).scalar()).select("*", "_m.*")
    smooth = sum((F.col(f"_b{i}") * F.get("_coef", F.col("_seg") + i) for i in range(1, 4)), F.col("_b0") * F.get("_coef", F.col("_seg")))
    return joined.select(*by, ts, value, smooth.alias("smooth"), "lambda")
