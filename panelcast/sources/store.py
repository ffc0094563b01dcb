"""Artefact store: slow intermediate results and fitted models kept per case name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


class Store:
    """Directory per ``(case, name)``; two switches say whether to write and whether to read."""

    def __init__(self, spark: SparkSession, root: str, case: str, save: bool = True, read: bool = True):
        self.spark, self.root, self.case = spark, root.rstrip("/"), case
        self.save_on, self.read_on = save, read

    def path(self, name: str) -> str:
        return f"{self.root}/{self.case}/{name}"

    def save(self, name: str, df: DataFrame) -> None:
        if self.save_on:
            df.write.mode("overwrite").parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def load_or_compute(self, name: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """Stored table if present, else compute it, store it and read it back."""
        if self.read_on:
            try:
                return self.load(name)
            except AnalysisException as err:
                if err.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
        df = compute()
        if not self.save_on:
            return df
        self.save(name, df)
        return self.load(name)

    def save_model(self, name: str, model) -> None:
        if self.save_on:
            model.write().overwrite().save(self.path(name))

    def load_model(self, name: str, loader=PipelineModel):
        return loader.load(self.path(name))
