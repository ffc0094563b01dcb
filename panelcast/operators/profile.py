"""Data-quality profile of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.aggregate import distinct_count
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.reshape import to_long
from panelcast.operators.window import zscore


def null_report(df: DataFrame, title: str) -> DataFrame:
    """Nulls of the whole table: count, percent with one decimal, sentence. One pass."""
    nulls = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    one = df.agg(nulls.alias("count"), (F.count("*") * len(df.columns)).alias("_cells"))
    percent = F.bround(F.col("count") / F.nullif(F.col("_cells"), F.lit(0)) * 100, 1)
    return one.select(
        "count",
        F.when(F.col("count") == 0, F.lit(0.0)).otherwise(percent).alias("number"),
        F.when(F.col("count") == 0, F.lit(f"No nulls in '{title}'"))
        .otherwise(F.concat(F.lit("There are "), F.format_string("%.1f", percent), F.lit(f"% nulls in '{title}'")))
        .alias("text"),
    )


def constant_columns(df: DataFrame, cols: Sequence[str], criteria: int = 1) -> DataFrame:
    """Columns whose distinct count (null is a value) equals ``criteria``.

    One distinct value needs only min, max and a null count; other criteria need the distinct counts.
    """
    if criteria != 1:
        return distinct_count(df, cols).where(F.col("n_distinct") == criteria).select("variable")
    flags = df.agg(
        *[
            (
                (F.count(F.col(c)) == 0) | ((F.count(F.col(c)) == F.count("*")) & (F.min(c) == F.max(c)))
            ).alias(c)
            for c in cols
        ]
    )
    return flags.unpivot([], list(cols), "variable", "constant").where("constant").select("variable")


def outlier_scores(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """z-score of every non-null cell, long; each column is scored over its own non-null values."""
    long = to_long(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]), ids, cols, "variable", "value")
    return zscore(long.where(F.col("value").isNotNull()), "value", ["variable"])


def outlier_table(scores: DataFrame, t: float = 3.0) -> DataFrame:
    return scores.groupBy((F.abs("z") >= t).alias("outlier")).agg(F.count("*").alias("n"))


def skim_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, missing, complete rate, mean, sd, p0/25/50/75/100 per numeric column."""
    long = to_long(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "variable", "value")
    stats = long.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        (F.count("value") / F.count("*")).alias("complete_rate"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("p0"),
        F.max("value").alias("p100"),
    )
    q = exact_quantiles(long, ["variable"], "value", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return stats.join(q, "variable", "left")


def skim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, missing, min/max length, empty, distinct per text column."""
    long = to_long(df, [], cols, "variable", "value")
    return long.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min(F.length("value")).alias("min_length"),
        F.max(F.length("value")).alias("max_length"),
        F.count_if(F.col("value") == "").alias("empty"),
        F.count_distinct("value").alias("n_unique"),
    )


def skim_date(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = to_long(df, [], cols, "variable", "value")
    return long.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count_distinct("value").alias("n_unique"),
    )


def split_by_type(df: DataFrame) -> dict[str, list[str]]:
    """Column names per type class of a skim."""
    out: dict[str, list[str]] = {"numeric": [], "text": [], "date": []}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            out["text"].append(f.name)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out["date"].append(f.name)
    return out


def glimpse(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Name, type and the first n values (in ``order``) of every column, as text."""
    head = df.orderBy(*order).limit(n)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = F.struct(*[F.col(c) for c in order])
    packed = head.groupBy().agg(
        *[
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(keys.alias("k"), F.col(c).cast("string").alias("v")))),
                    lambda s: F.coalesce(s["v"], F.lit("NA")),
                ),
                ", ",
            ).alias(c)
            for c in df.columns
        ]
    )
    long = packed.unpivot([], list(df.columns), "name", "values")
    kind = F.create_map(*[F.lit(v) for kv in types.items() for v in kv])
    return long.select("name", kind[F.col("name")].alias("type"), "values")
