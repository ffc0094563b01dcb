"""The data behind histograms, density curves, box plots and heat maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import add_calendar
from panelcast.operators.joins import join_groups
from panelcast.operators.quantiles import exact_quantiles

ALL = "_all"  # stand-in group key when there is no grouping


def _keyed(df: DataFrame, by: Sequence[str], col: str) -> tuple[DataFrame, list[str]]:
    keys = list(by) or [ALL]
    out = df.select(*by, *([] if by else [F.lit(0).alias(ALL)]), F.col(col).cast("double").alias("_x"))
    return out.where(F.col("_x").isNotNull()), keys


def histogram(df: DataFrame, col: str, bins: int | None = 30, by: Sequence[str] = (), group_range: bool = False) -> DataFrame:
    """Equal-width bins: count and density. ``bins=None`` takes Sturges' number per range.

    The range is that of the whole column (facets share their axis) unless ``group_range``.
    Empty bins are not listed.
    """
    data, keys = _keyed(df, by, col)
    k = F.ceil(F.log2(F.col("_t"))) + 1 if bins is None else F.lit(bins)
    rng = [F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("*").alias("_t")]
    if by and not group_range:
        whole = data.agg(*rng).select(F.struct("_lo", "_hi", "_t")).scalar()
        data = data.withColumn("_r", whole).select(*keys, "_x", "_r.*")
    else:
        data = join_groups(data, data.groupBy(*keys).agg(*rng), keys, 3)
    width = (F.col("_hi") - F.col("_lo")) / k
    data = data.withColumn("_k", k.cast("int")).withColumn("_w", F.when(F.col("_hi") > F.col("_lo"), width).otherwise(1.0))
    bin_no = F.least(F.col("_k") - 1, F.floor((F.col("_x") - F.col("_lo")) / F.col("_w"))).cast("int")
    counts = data.groupBy(*keys, "_lo", "_w", bin_no.alias("bin")).agg(F.count("*").alias("count"))
    sizes = counts.groupBy(*keys).agg(F.sum("count").alias("_n"))
    out = counts.join(sizes, keys).select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), "count",
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"),
    )
    return out if by else out.drop(ALL)


def kde(df: DataFrame, col: str, grid: int = 512, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian kernel density on ``grid`` points from min to max of each group.

    Rows are first counted on the grid (at most ``grid`` rows per group), the kernel sum runs on those
    counts only. Bandwidth 0.9 * min(sd, IQR / 1.34) * n^(-1/5).
    """
    data, keys = _keyed(df, by, col)
    moments = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    )
    q = exact_quantiles(data, keys, "_x", [0.25, 0.75], ["_q1", "_q3"])
    iqr = (F.col("_q3") - F.col("_q1")) / F.lit(1.34)
    spread = F.when(iqr > 0, F.least("_sd", iqr)).otherwise(F.col("_sd"))
    bw = F.lit(0.9) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    par = (
        moments.join(q, keys)
        .select(*keys, "_n", "_lo", bw.alias("_bw"), ((F.col("_hi") - F.col("_lo")) / (grid - 1)).alias("_s"))
        .where((F.col("_bw") > 0) & (F.col("_s") > 0))
    )
    cell = F.least(F.lit(grid - 1), F.floor((F.col("_x") - F.col("_lo")) / F.col("_s") + 0.5)).cast("int")
    counts = join_groups(data, par, keys, 4).groupBy(*keys, "_n", "_lo", "_bw", "_s", cell.alias("_b")).agg(F.count("*").alias("_m"))
    u = (F.col("point") - F.col("_b")) * F.col("_s") / F.col("_bw")
    kernel = F.col("_m") * F.exp(F.lit(-0.5) * u * u)
    out = (
        counts.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .groupBy(*keys, "_n", "_lo", "_bw", "_s", "point")
        .agg(F.sum(kernel).alias("_f"))
        .select(
            *keys, "point", (F.col("_lo") + F.col("point") * F.col("_s")).alias("x"),
            (F.col("_f") / (F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
        )
    )
    return out if by else out.drop(ALL)


def boxplot_stats(df: DataFrame, col: str, by: Sequence[str] = (), coef: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last point within ``coef`` * IQR, number of points beyond."""
    data, keys = _keyed(df, by, col)
    q = exact_quantiles(data, keys, "_x", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("_x").between(F.col("q1") - coef * iqr, F.col("q3") + coef * iqr)
    out = (
        join_groups(data, q, keys, 3)
        .groupBy(*keys, "q1", "q2", "q3")
        .agg(
            F.min(F.when(inside, F.col("_x"))).alias("lower"),
            F.max(F.when(inside, F.col("_x"))).alias("upper"),
            F.count_if(~inside).alias("outliers"),
            F.count("*").alias("n"),
        )
    )
    return out if by else out.drop(ALL)


def boxplot_outliers(df: DataFrame, col: str, by: Sequence[str], coef: float = 1.5) -> DataFrame:
    """The rows drawn as single points."""
    q = exact_quantiles(df, by, col, [0.25, 0.75], ["_q1", "_q3"])
    iqr = F.col("_q3") - F.col("_q1")
    far = ~F.col(col).between(F.col("_q1") - coef * iqr, F.col("_q3") + coef * iqr)
    return join_groups(df, q, by, 2).where(far).drop("_q1", "_q3")


def weighted_grid(points: DataFrame, cell: float, x: str = "lon", y: str = "lat", weight: str = "value") -> DataFrame:
    """Weight summed per spatial cell (heat map)."""
    return points.groupBy(
        F.floor(F.col(x) / F.lit(float(cell))).cast("bigint").alias("cx"),
        F.floor(F.col(y) / F.lit(float(cell))).cast("bigint").alias("cy"),
    ).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def period_distribution(panel: DataFrame, period: str, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Box-plot table by a calendar column (year, month, day_of_week, ...) and optional groups."""
    return boxplot_stats(add_calendar(panel), value, [*by, period])
