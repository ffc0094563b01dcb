"""Tree ensembles by MLlib: one distributed fit per parameter point."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pipeline(regressor, xs: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(xs), outputCol="_features", handleInvalid="skip"), regressor])


def random_forest(
    df: DataFrame, y: str, xs: Sequence[str], mtry: int, trees: int = 20, depth: int = 5, seed: int = 42
) -> PipelineModel:
    """``mtry`` of the predictors are tried at each split."""
    rf = RandomForestRegressor(
        labelCol=y, featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed,
        featureSubsetStrategy=str(min(mtry, len(xs))) if mtry < len(xs) else "all",
    )
    return _pipeline(rf, xs).fit(df)


def boosted_trees(df: DataFrame, y: str, xs: Sequence[str], params: Mapping, seed: int = 42) -> PipelineModel:
    """``rounds, depth, eta, subsample, colsample``."""
    gbt = GBTRegressor(
        labelCol=y, featuresCol="_features", seed=seed, maxIter=int(params.get("rounds", 20)), maxDepth=int(params.get("depth", 4)),
        stepSize=float(params.get("eta", 0.1)), subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(float(params["colsample"])) if params.get("colsample", 1.0) < 1 else "all",
    )
    return _pipeline(gbt, xs).fit(df)


def tree_grid(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping], kind: str = "forest", split: str = "split", parallel: int = 4
) -> DataFrame:
    """MSE and MAE on train and val for every point, and how many rows a missing predictor leaves out; points are fitted a few at a time."""
    gap = reduce(lambda a, b: a | b, [F.col(x).isNull() | F.isnan(F.col(x).cast("double")) for x in xs])
    left_out = float(df.where(F.col(split).isin("train", "val") & gap).count())
    train = df.where(F.col(split) == "train")

    def run(point: Mapping) -> tuple:
        model = (
            random_forest(train, y, xs, int(point["mtry"]), int(point.get("trees", 20)), int(point.get("depth", 5)))
            if kind == "forest" else boosted_trees(train, y, xs, point)
        )
        err = F.col("prediction") - F.col(y)
        rows = {
            r[0]: r[1:] for r in model.transform(df).groupBy(split).agg(F.avg(err * err), F.avg(F.abs(err))).collect()
        }
        empty = (None, None)
        return tuple(float(v) for v in point.values()) + tuple(rows.get("train", empty)) + tuple(rows.get("val", empty)) + (left_out,)

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(run, grid))
    names = [*grid[0], "mse_train", "mae_train", "mse_val", "mae_val", "left_out"]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
