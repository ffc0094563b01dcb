"""Search, refit and bookkeeping over many entities."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.metrics import fit_diagnosis, split_metrics
from panelcast.operators.models.kernel import fourier_map, polynomial_columns
from panelcast.operators.models.linear import fit, fit_grid, predict, score_points
from panelcast.operators.rank import best_by
from panelcast.operators.resampling import Bootstrap, KFold, fold_search, window_search


def grid_search(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str], kind: str = "ridge", split: str = "split",
    folds: DataFrame | KFold | Bootstrap | str | None = None, idx: str = "idx",
) -> DataFrame:
    """Metrics of every (group, point): MSE from the moments, MAE from one streamed scoring pass per split.

    With ``folds`` of every (group, fold, point): fold windows (fold, role, lo, hi) over ``idx``, a division, bootstrap samples,
    or the name of a column of fold numbers (see ``resampling``).
    """
    if isinstance(folds, DataFrame):
        return window_search(df, y, xs, grid, by, folds, kind, idx)
    if folds is not None:
        return fold_search(df, y, xs, grid, by, folds, kind)
    points = fit_grid(df, y, xs, grid, by, kind, split)
    out = points
    for part in ("train", "val"):
        mae = score_points(df.where(F.col(split) == part), y, xs, points, by, by).withColumnRenamed("mae", f"mae_{part}")
        out = out.join(mae, [*by, "point"], "left")
    return out


def family_search(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str], family: str = "radial", split: str = "split", size: int = 64
) -> DataFrame:
    """Every (group, point) of a non-linear family: MSE on train and val, one moment pass for each feature map.

    ``radial`` points have sigma and lambda (random Fourier features), ``poly`` points degree, scale and
    lambda (monomials). Points that share a map share its moments; only their p x p sums are solved.
    """
    maps: dict[tuple, list[tuple[int, Mapping]]] = {}
    for i, point in enumerate(grid):
        maps.setdefault((point["sigma"],) if family == "radial" else (int(point["degree"]), float(point.get("scale", 1.0))), []).append((i, point))
    out = []
    for key, points in maps.items():
        if family == "radial":
            held = df.withColumn("_z", fourier_map(xs, key[0], size))
            terms = {f"_z{k}": F.col("_z")[k] for k in range(size)}
        else:
            held, terms = df, polynomial_columns(xs, *key)
        rows = held.select(*by, split, y, *[c.alias(n) for n, c in terms.items()])
        fitted = fit_grid(rows, y, list(terms), [{"lambda": p["lambda"]} for _, p in points], by, "ridge", split)
        number = F.array(*[F.lit(i) for i, _ in points])
        out.append(fitted.select(
            *by, number[F.col("point")].alias("point"), *[F.lit(float(v)).alias(n) for n, v in zip(("sigma",) if family == "radial" else ("degree", "scale"), key)],
            "lambda", "coef", "mse_train", "mse_val",
        ))
    return reduce(DataFrame.unionByName, out)


def refit_best(
    df: DataFrame, y: str, xs: Sequence[str], results: DataFrame, grid: Sequence[Mapping[str, float]], by: Sequence[str], kind: str = "ridge",
    split: str = "split",
) -> DataFrame:
    """Winner per group (least validation MSE, then its number) refitted on train+val, measured on test."""
    win = best_by(results.select(*by, "mse_val", "point"), by, ["mse_val", "point"]).select(*by, "point")
    train_val = df.where(F.col(split).isin("train", "val")).withColumn(split, F.lit("train"))
    models = fit_grid(train_val, y, xs, grid, by, kind, split).join(win, [*by, "point"])
    scored = predict(df, models, xs, by)
    measured = fit_diagnosis(split_metrics(scored, y, "prediction", by, split))
    return models.select(*by, "point").join(measured, list(by))


def per_entity(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], kind: str = "ols", params: Mapping | None = None, split: str = "split") -> DataFrame:
    """Fit on train, score all splits, diagnose - for every entity at once; the entity is a grouping key."""
    models = fit(df.where(F.col(split) == "train"), y, xs, by, kind, params)
    scored = predict(df, models, xs, by)
    return fit_diagnosis(split_metrics(scored, y, "prediction", by, split), "mae_train", "mae_test")


def fit_log(spark, runs: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Run named fits and log name, start, seconds and the mean error ratio of each."""
    rows = []
    for name, run in runs.items():
        start, t0 = time.time(), time.perf_counter()
        ratio = run().agg(F.avg("mae_ratio")).first()[0]
        rows.append((name, start, time.perf_counter() - t0, ratio))
    return spark.createDataFrame(rows, "run string, started double, seconds double, mae_ratio double")


def fit_log_points(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str], kind: str = "ridge", split: str = "split"
) -> DataFrame:
    """One row for each (group, point): start and seconds of its fit, measured in the task that solves it, and its error ratio.

    The ratio is MSE on val over MSE on train; fits of all groups run side by side, so seconds add up to more than the job took.
    """
    fits = fit_grid(df, y, xs, grid, by, kind, split, timed=True)
    return fits.drop("coef").withColumn("mse_ratio", F.col("mse_val") / F.nullif("mse_train", F.lit(0.0)))
