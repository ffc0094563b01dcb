"""The one job with a published run time, at its published size: 98 targets x 357 predictors by day.

Targets and predictors are daily sums that Spark derives from the order lines: the targets are the 98
suppliers with the largest totals, the predictors are the products in 357 groups.
Both keep every row of their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.frame import filter_in
from panelcast.operators.rank import top_k
from panelcast.operators.reshape import to_wide
from panelcast.operators.select import importance_all
from panelcast.plans.tables import Tables


def importance_98(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    names = [f"PC{k}" for k in range(357)]
    groups = t.lineitem.select(
        F.to_date("l_shipdate").alias("ts"), F.concat(F.lit("PC"), F.col("l_partkey") % 357).alias("name"),
        F.col("l_extendedprice").alias("value"),
    ).groupBy("ts", "name").agg(F.sum("value").alias("value"))
    features = to_wide(groups, ["ts"], "name", "value", names).fillna(0.0)
    targets = filter_in(t.panel, "entity", top_k(t.panel, 98).select("entity"))
    return importance_all(targets, features, names, n=50)
