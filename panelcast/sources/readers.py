"""Readers and the submission writer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATION_SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("elev", T.IntegerType()),
    ]
)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN is a missing value everywhere in the library."""
    fixed = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a wide or long table (parquet brings its schema, CSV needs one) and map NaN to null."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        raise ValueError("a CSV panel needs an explicit schema")
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.load(path))


def read_stations(spark: SparkSession, path: str, schema: T.StructType = STATION_SCHEMA) -> DataFrame:
    """Headered CSV of entity positions, with a declared schema instead of inference."""
    return spark.read.schema(schema).csv(path, header=True)


def write_submission(df: DataFrame, path: str, order: Sequence[str] = ("ts",)) -> None:
    """CSV directory: comma, point, header, no quotes, rows in the given order across part files."""
    (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .write.mode("errorifexists")
        .option("header", True)
        .option("quote", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )
