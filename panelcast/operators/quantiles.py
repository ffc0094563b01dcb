"""Exact quantiles that never gather a large group into one task.

The built-in ``percentile`` keeps every distinct value of a group in one aggregation buffer. It is used
for groups whose measured size fits a task. Larger groups are spread: rows are counted in cells along
the value axis, the counts say exactly which cells hold the wanted order statistics, and only the values
of those cells are ranked. The cells lie inside narrow brackets taken from a bounded sketch, so that
skewed values cannot crowd one cell; the sketch only places cells, it never decides a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

TASK_ROWS = 100_000  # a group up to this size is handled by one task
ACCURACY = 2_000  # sketch rank error = n / ACCURACY
MARGIN = 3.0 / ACCURACY
CELLS = 1024  # cells between two neighbouring edges
BROADCAST_GROUPS = 10_000  # edge tables up to this many large groups are sent to every task


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Sequence[float], names: Sequence[str], task_rows: int = TASK_ROWS
) -> DataFrame:
    """Quantiles with linear interpolation between order statistics; one row per group.

    Starts with one counting job, whose result decides how groups are handled.
    """
    by = list(by)
    keys = by or ["_all"]
    base = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), F.col(col).cast("double").alias("_x"))
    base = base.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    sizes = base.groupBy(*keys).agg(F.count("*").alias("_n"))
    fits = F.col("_n") <= task_rows
    small, big = sizes.agg(F.count_if(fits), F.count_if(~fits)).first()
    if big == 0:
        out = _in_task(base, keys, probs, names)
    elif small == 0:
        out = _spread(base, keys, probs, names, big)
    else:
        part = lambda cond: base.join(sizes.where(cond).select(*keys), keys, "left_semi")
        out = _in_task(part(fits), keys, probs, names).unionByName(_spread(part(~fits), keys, probs, names, big))
    return out if by else out.drop("_all")


def _in_task(base: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    q = base.groupBy(*keys).agg(F.percentile("_x", [float(p) for p in probs]).alias("_q"))
    return q.select(*keys, *[F.col("_q")[j].alias(n) for j, n in enumerate(names)])


def _spread(base: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str], groups: int) -> DataFrame:
    around = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-MARGIN, MARGIN)})
    frame = base.groupBy(*keys).agg(
        F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", around, ACCURACY).alias("_q")
    )
    frame = cut_lineage(frame.select(*keys, F.concat(F.array("_min"), "_q", F.array("_max")).alias("_e")))
    if groups <= BROADCAST_GROUPS:
        frame = F.broadcast(frame)

    # interval = number of edges at or below x, cell = position inside the interval; both grow with x
    interval = sum((F.when(F.col("_x") >= F.get("_e", F.lit(i)), 1).otherwise(0) for i in range(len(around) + 2)), F.lit(0))
    lo, hi = F.get("_e", F.col("_i") - 1), F.get("_e", F.col("_i"))
    inside = F.when(hi > lo, F.least(F.lit(CELLS - 1), F.floor((F.col("_x") - lo) / (hi - lo) * CELLS))).otherwise(0)
    placed = (
        base.join(frame, keys)
        .select(*keys, "_x", "_e", interval.alias("_i"))
        .select(*keys, "_x", (F.col("_i") * CELLS + F.coalesce(inside, F.lit(0))).cast("int").alias("_c"))
    )

    counts = placed.groupBy(*keys, "_c").agg(F.count("*").alias("_m"))
    group = W.partitionBy(*keys)
    counts = counts.withColumns(
        {
            "_end": F.sum("_m").over(group.orderBy("_c").rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_n": F.sum("_m").over(group),
        }
    ).withColumn("_before", F.col("_end") - F.col("_m"))
    rank = [F.floor((F.col("_n") - 1) * F.lit(float(p))) for p in probs]
    within = lambda k, a, b: (F.col(a) <= k) & (k < F.col(b))
    wanted = F.lit(False)
    for k in rank:
        wanted = wanted | within(k, "_before", "_end") | within(k + 1, "_before", "_end")
    hit = counts.where(wanted).select(*keys, "_c", "_before", "_n")

    values = placed.join(hit, [*keys, "_c"]).groupBy(*keys, "_c", "_before", "_n", "_x").agg(F.count("*").alias("_m"))
    upto = W.partitionBy(*keys, "_c").orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = values.withColumn("_hi", F.col("_before") + F.sum("_m").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_m"))
    aggs = []
    for j, k in enumerate(rank):
        low = F.max(F.when(within(k, "_lo", "_hi"), F.col("_x")))
        aggs += [low.alias(f"_a{j}"), F.coalesce(F.max(F.when(within(k + 1, "_lo", "_hi"), F.col("_x"))), low).alias(f"_b{j}")]
    picked = ranked.groupBy(*keys, "_n").agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_a{j}") + (F.col(f"_b{j}") - F.col(f"_a{j}")) * ((F.col("_n") - 1) * F.lit(float(p)) - rank[j])).alias(n)
            for j, (p, n) in enumerate(zip(probs, names))
        ],
    )
