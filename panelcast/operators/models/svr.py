"""Linear support-vector regression with squared epsilon-insensitive loss, all groups in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.joins import join_groups
from panelcast.operators.models.linear import COEF, fit, linear_score
from panelcast.operators.moments import gram, gram_matrix, per_group
from panelcast.session import cut_lineage


STEPS = 200  # Newton and halving steps until every group must have settled


def linear_svr(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), cost: float = 1.0, epsilon: float = 0.1, tol: float = 1e-9,
) -> DataFrame:
    """Minimises |b|^2 / 2 + cost * sum(max(0, |y - f(x)| - epsilon)^2); rows inside the tube count nothing.

    One job a step for all groups. The moments of the rows outside the tube, taken against the nearer
    tube wall, give the objective, the gradient and a Newton direction; a step that does not lower the
    objective by a share of what the gradient promises is halved. A group whose rows are all inside has
    zero moments and goes on to smaller slopes. Steps end when every group's promise is below ``tol`` of
    its objective; groups that have not settled after STEPS raise. Put predictors on one scale before
    (see ``Scaler``). The state table has one row per group.
    """
    by = list(by)
    keys = by or ["_all"]
    size = len(xs) + 2
    array = COEF.dataType
    penalty = np.diag([0.0] + [1.0] * len(xs))
    state_fields = [COEF, T.StructField("best", array), T.StructField("step", array), T.StructField("promise", T.DoubleType()),
                    T.StructField("share", T.DoubleType()), T.StructField("objective", T.DoubleType()), T.StructField("done", T.BooleanType())]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        g = gram_matrix(pdf, size)
        first = pdf.iloc[0]
        coef, best, move = (np.asarray(first[c], dtype=float) for c in ("coef", "best", "step"))
        share, promise, objective = float(first["share"]), float(first["promise"]), float(first["objective"])
        if first["done"]:
            return pd.DataFrame([[coef, best, move, promise, share, objective, True]], columns=[f.name for f in state_fields])
        v = np.concatenate([-coef, [1.0]])
        value = 0.5 * coef[1:] @ coef[1:] + cost * max(float(v @ g @ v), 0.0)
        if value > objective - 1e-4 * share * promise:
            share /= 2
            return pd.DataFrame([[best + share * move, best, move, promise, share, objective, share * promise <= tol * (1e-300 + objective)]],
                                columns=[f.name for f in state_fields])
        slope = penalty @ coef - 2 * cost * (g[:-1, -1] - g[:-1, :-1] @ coef)
        move = np.linalg.lstsq(penalty + 2 * cost * g[:-1, :-1], -slope, rcond=None)[0]
        promise = float(-slope @ move)
        done = promise <= tol * (1e-300 + value)
        return pd.DataFrame([[coef if done else coef + move, coef, move, promise, 1.0, value, done]], columns=[f.name for f in state_fields])

    data = df.select(*(by or [F.lit(0).alias("_all")]), y, *xs).dropna()
    start = fit(data, y, xs, keys).select(*keys, "coef")
    state = cut_lineage(start.select(
        *keys, "coef", F.col("coef").alias("best"), F.transform("coef", lambda c: F.lit(0.0)).alias("step"), F.lit(0.0).alias("promise"),
        F.lit(1.0).alias("share"), F.lit(float("inf")).alias("objective"), F.lit(False).alias("done"),
    ))
    for _ in range(STEPS):
        if not state.where("NOT done").limit(1).count():
            break
        open_groups = state.where("NOT done").select(*keys, "coef")
        err = F.col(y) - linear_score("coef", xs)
        joined = join_groups(data, open_groups, keys, len(xs) + 1)
        outside = joined.withColumn("_e", err).where(F.abs("_e") > epsilon).withColumn("_t", F.col(y) - F.signum("_e") * F.lit(epsilon))
        none = state.select(*keys, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("s"))
        cells = gram(outside, [*xs, "_t"], keys).select(*keys, "i", "j", "s").unionByName(none).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
        state = cut_lineage(per_group(cells.join(state, keys), keys, step, T.StructType(state_fields)))
    else:
        if left := state.where("NOT done").count():
            raise ArithmeticError(f"{left} groups have not settled after {STEPS} steps")
    return state.select(*by, F.col("best").alias("coef"), "objective")
