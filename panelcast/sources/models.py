"""Fitted models of every entity, kept in versions and scored without the code that fitted them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.joins import join_groups
from panelcast.operators.models.kernel import fourier_map, polynomial_columns
from panelcast.operators.preprocess import Scaler

SPEC = ["family", "xs", "mean", "sd", "feature_map"]


def described(models: DataFrame, xs: Sequence[str], family: str, scaler: Scaler | None = None, feature_map: Mapping[str, float] | None = None) -> DataFrame:
    """``models`` (by..., coef, ...) with all that scoring needs: predictors, their scaling, and the map from predictors to features.

    ``feature_map`` is None for the predictors as they are, {sigma, size, seed} for random features of the radial kernel,
    {degree, scale} for monomials.
    """
    scaler = scaler or Scaler({}, {})
    array = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return models.withColumns({
        "family": F.lit(family), "xs": array(xs, "string"), "mean": array([scaler.mean.get(x, 0.0) for x in xs], "double"),
        "sd": array([scaler.sd.get(x, 1.0) for x in xs], "double"), "feature_map": F.lit(json.dumps(dict(feature_map or {}), sort_keys=True)),
    })


class ModelStore:
    """Versions of model tables below ``root``/name.

    A version is written under a name of its own and becomes the current one by a single rename of a finished folder; readers take the
    highest number there is, so they never see half a version, and a load of an older one still works.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        """File system of a path, from the session."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self, name: str) -> list[int]:
        """Numbers of the finished versions."""
        system, place = self._files(f"{self.root}/{name}")
        if not system.exists(place):
            return []
        found = [s.getPath().getName() for s in system.listStatus(place)]
        return sorted(int(f[1:]) for f in found if f[:1] == "v" and f[1:].isdigit())

    def save(self, name: str, models: DataFrame) -> int:
        """Stores a version and returns its number."""
        draft = f"{self.root}/{name}/.draft-{uuid.uuid4().hex}"
        models.write.parquet(draft)
        system, place = self._files(draft)
        number = max(self.versions(name), default=0) + 1
        # a folder renamed onto one that is there would land inside it, so two writers must not take one number
        while not self._moved(system, place, f"{self.root}/{name}/v{number:08d}"):
            number += 1
        return number

    def _moved(self, system, draft, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return not system.exists(target) and system.rename(draft, target)

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """The current version, or the one asked for."""
        there = self.versions(name)
        if not there or (version is not None and version not in there):
            raise FileNotFoundError(f"no {'version ' + str(version) if version else 'models'} of {name} below {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or there[-1]:08d}")


def score_stored(df: DataFrame, stored: DataFrame, by: Sequence[str], name: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its group's stored model; null without a model or where a predictor is missing.

    All models of a stored table share one specification.
    """
    specs = stored.select(*SPEC).distinct().limit(2).collect()
    if not specs:
        return df.withColumn(name, F.lit(None).cast("double"))
    if len(specs) > 1:
        raise ValueError("the stored models differ in predictors, scaling or feature map")
    spec, kind = specs[0], json.loads(specs[0]["feature_map"])
    names = [f"_f{k}" for k in range(len(spec["xs"]))]
    rows = df.withColumns({n: (F.col(x).cast("double") - F.lit(m)) / F.lit(s) for n, x, m, s in zip(names, spec["xs"], spec["mean"], spec["sd"], strict=True)})
    if "sigma" in kind:
        size = int(kind.get("size", 64))
        vector = F.when(F.forall(F.array(*names), lambda v: v.isNotNull()), fourier_map([*names], float(kind["sigma"]), size, int(kind.get("seed", 42))))
    elif "degree" in kind:
        vector = F.array(*polynomial_columns(names, int(kind["degree"]), float(kind.get("scale", 1.0))).values())
    else:
        vector = F.array(*names) if names else F.array().cast("array<double>")
    rows = join_groups(rows.withColumn("_z", vector), stored.select(*by, F.col("coef").alias("_coef")), by, 100, "left")
    dot = F.aggregate(F.zip_with(F.slice("_coef", 2, F.greatest(F.size("_coef") - 1, F.lit(0))), "_z", lambda b, z: b * z), F.get("_coef", F.lit(0)), lambda s, v: s + v)
    return rows.withColumn(name, dot).drop("_coef", "_z", *names)

