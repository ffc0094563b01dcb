"""Feature importance of all targets in one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.rank import top_features


WIDE = 40  # from here on columns travel as one array instead of one expression each


def _number(x: str) -> Column:
    """The column as a double; NaN is missing, as null is."""
    return F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))


def _opened(df: DataFrame, by: Sequence[str], y: str, values: Sequence[Column] | Column) -> DataFrame:
    """One row ``(by, _y, _f, _x)`` per row and feature number; aggregated map-side right after."""
    head = [*by, F.col(y).cast("double").alias("_y")]
    if isinstance(values, Column):
        return df.select(*head, F.posexplode(values).alias("_f", "_x"))
    names = [f"_v{k}" for k in range(len(values))]
    wide = df.select(*head, *[v.alias(n) for v, n in zip(values, names)])
    long = wide.unpivot([*by, "_y"], names, "_f", "_x")
    return long.withColumn("_f", F.substring("_f", 3, 9).cast("int"))


def importance_linear(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """|t| of the slope of y on each feature: |r| sqrt((n - 2) / (1 - r^2))."""
    names = F.array(*[F.lit(x) for x in xs])
    cols = [_number(x) for x in xs]
    long = _opened(df, by, y, cols if len(xs) <= WIDE else F.array(*cols)).where("_y IS NOT NULL AND _x IS NOT NULL")
    stats = long.groupBy(*by, "_f").agg(F.corr("_y", "_x").alias("_r"), F.count("*").alias("_n"))
    score = F.abs("_r") * F.sqrt((F.col("_n") - 2) / F.nullif(1 - F.col("_r") * F.col("_r"), F.lit(0.0)))
    return stats.select(*by, F.get(names, F.col("_f")).alias("feature"), score.alias("score"))


def quantile_edges(df: DataFrame, xs: Sequence[str], bins: int) -> list[list[float]]:
    """Inner quantile edges per feature: (bins - 1) numbers each, whatever the data size."""
    probs = [k / bins for k in range(1, bins)]
    names = [f"e{k}" for k in range(1, bins)]
    cols = [_number(x) for x in xs]
    long = _opened(df.withColumn("_c", F.lit(0.0)), [], "_c", cols if len(xs) <= WIDE else F.array(*cols))
    rows = {r["_f"]: [r[n] for n in names] for r in exact_quantiles(long, ["_f"], "_x", probs, names).collect()}
    return [sorted(set(rows.get(k, []))) for k in range(len(xs))]


def bin_columns(xs: Sequence[str], edges: Sequence[Sequence[float]]) -> list[Column] | Column:
    """Bin number (count of edges below the value, null for null and NaN) per feature: columns, or one array if many."""
    if len(xs) <= WIDE:
        one = lambda x, es: sum((F.when(_number(x) > F.lit(e), 1).otherwise(0) for e in es), F.lit(0))
        return [F.when(_number(x).isNotNull(), one(x, es)) for x, es in zip(xs, edges)]
    arrays = [np.asarray(e, dtype=float) for e in edges]

    def cut(v: pd.Series) -> pd.Series:
        m = np.vstack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(arrays)))
        out = np.column_stack([np.searchsorted(e, m[:, k], side="left") for k, e in enumerate(arrays)]).astype("int32")
        gaps = np.isnan(m)
        if not gaps.any():
            return pd.Series(list(out))
        return pd.Series([np.where(g, None, o) for g, o in zip(gaps, out)])

    return F.pandas_udf(cut, T.ArrayType(T.IntegerType()))(F.array(*[_number(x) for x in xs]))


def _binned_scores(binned: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], bins: Sequence[Column] | Column) -> DataFrame:
    """Correlation ratio SS_between / SS_total over the bins of each feature."""
    names = F.array(*[F.lit(x) for x in xs])
    cells = (
        _opened(binned, by, y, bins).where("_y IS NOT NULL AND _x IS NOT NULL")
        .groupBy(*by, "_f", "_x").agg(F.count("*").alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))
    )
    mean = F.sum("_s") * F.sum("_s") / F.sum("_n")
    between = F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - mean
    return cells.groupBy(*by, "_f").agg((between / F.nullif(F.sum("_q") - mean, F.lit(0.0))).alias("score")).select(
        *by, F.get(names, F.col("_f")).alias("feature"), "score"
    )


def importance_nonpara(df: DataFrame, y: str, xs: Sequence[str], bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """R^2 of a step function of each feature over its quantile bins; y itself is never a candidate."""
    xs = [x for x in xs if x != y]
    return _binned_scores(df, by, y, xs, bin_columns(xs, quantile_edges(df, xs, bins)))


def importance_all(
    panel: DataFrame, features: DataFrame, xs: Sequence[str], n: int = 50, bins: int = 10, target: str = "entity", ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Ranked features of every target. Features are binned once per date, then matched to the panel."""
    numbers = bin_columns(xs, quantile_edges(features, xs, bins))
    if isinstance(numbers, Column):
        binned, opened = features.select(ts, numbers.alias("_bins")), F.col("_bins")
    else:
        held = [f"_b{k}" for k in range(len(xs))]
        binned, opened = features.select(ts, *[c.alias(n) for c, n in zip(numbers, held)]), [F.col(n) for n in held]
    joined = panel.select(target, ts, value).join(binned, ts)
    scores = _binned_scores(joined, [target], value, xs, opened).withColumnRenamed(target, "target")
    return top_features(scores, n)
