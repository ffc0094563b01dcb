"""Forecasts for rows whose value is not known yet."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.models.linear import linear_score, predict
from panelcast.operators.ordering import entity_index
from panelcast.operators.reshape import entity_columns, to_wide
from panelcast.operators.window import lag_names


def forecast_direct(models: DataFrame, new_rows: DataFrame, xs: Sequence[str], names: Sequence, by: str = "entity", ts: str = "ts") -> DataFrame:
    """Score new rows of every entity without lags; one column per entity."""
    scored = predict(new_rows, models, xs, [by])
    return to_wide(scored, [ts], by, "prediction", names)


def forecast_recursive(
    history: DataFrame, future: DataFrame, models: DataFrame, xs: Sequence[str] = (), step: int = 30, times: int = 5,
    by: Sequence[str] = ("cluster",), ts: str = "ts", value: str = "value", rest: str | None = None,
) -> DataFrame:
    """Day-by-day forecast with lags of already predicted values, in blocks of the smallest lag.

    ``models.coef`` is ``[intercept, xs..., lags...]`` with lags of step, 2 step, .. rows. The part of the
    score that needs no lag is added up as a column expression; per group only the last step * times
    known values and the future rows meet in one task, however long the history is. Values of a block
    depend on earlier blocks only, so a block is computed at once and equals the row-by-row loop. A
    future row with a null predictor keeps its place and has a null prediction; so have the rows whose
    lags reach it.
    """
    keys, depth = list(by), step * times
    size = history.groupBy(*keys).agg(F.count("*").alias("_n"))
    tail = (
        entity_index(history.select(*keys, ts, value), keys, ts, "_idx").join(size, keys).where(F.col("_idx") > F.col("_n") - depth)
        .select(*keys, ts, F.col(value).alias("_v"), F.lit(None).cast("double").alias("_base"), F.lit(None).cast("array<double>").alias("_w"), F.lit(True).alias("_known"))
    )
    cut = len(xs) + 1
    scored = (
        future.join(models.select(*keys, "coef"), keys)
        .withColumn("_base", linear_score("coef", xs))
        .select(*keys, ts, F.lit(None).cast("double").alias("_v"), "_base", F.slice("coef", cut + 1, times).alias("_w"), F.lit(False).alias("_known"))
    )

    def roll(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts, kind="stable")
        known = pdf["_known"].to_numpy(dtype=bool)
        past, new = pdf.loc[known, "_v"].to_numpy(dtype=float), pdf[~known]
        out = np.concatenate([np.full(max(depth - len(past), 0), np.nan), past, np.full(len(new), np.nan)])
        first = len(out) - len(new)
        if len(new):
            base, w = new["_base"].to_numpy(dtype=float), np.asarray(new["_w"].iloc[0], dtype=float)
            for a in range(0, len(new), step):
                at = np.arange(first + a, first + min(a + step, len(new)))
                out[at] = base[at - first] + sum(w[i] * out[at - step * (i + 1)] for i in range(times))
        res = pd.DataFrame({ts: new[ts].to_numpy(), "prediction": out[first:]})
        for n, k in enumerate(keys):
            res[k] = [key[n]] * len(res)
        return res[[*keys, ts, "prediction"]]

    schema = T.StructType([history.schema[k] for k in keys] + [T.StructField(ts, T.DateType()), T.StructField("prediction", T.DoubleType())])
    return tail.unionByName(scored).groupBy(*keys).applyInPandas(roll, schema)


def lag_features(xs: Sequence[str], step: int = 30, times: int = 5, value: str = "value") -> list[str]:
    """Predictor order that ``forecast_recursive`` expects."""
    return [*xs, *lag_names(step, times, value)]


def future_dates(panel: DataFrame, days: int, by: Sequence[str] = ("cluster",), ts: str = "ts") -> DataFrame:
    """The next ``days`` dates after the last known one, for every group."""
    last = panel.groupBy(*by).agg(F.max(ts).alias("_last"))
    return last.select(*by, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))).alias(ts))


def submission(forecast: DataFrame, members: DataFrame, names: DataFrame, first=None, ts: str = "ts") -> DataFrame:
    """Cluster forecast copied to its members in the given column order, future rows only."""
    rows = forecast if first is None else forecast.where(F.col(ts) >= F.lit(first).cast("date"))
    return entity_columns(rows.select("cluster", ts, F.col("prediction").alias("value")), members, names, ts)
