"""Parameter search of the linear families over folds, windows and bootstrap samples, from moments.

The rows are read once for the moments, whatever the number of folds and points: windows are differences
of running totals over calendar blocks, folds are the total without one part, bootstrap samples are
weighted moments of all replicates from one matrix product a batch. A second, streamed pass gives the mean absolute errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.joins import range_join_folds
from panelcast.operators.models.linear import COEF, mse_of, score_points, score_samples, solve_moments
from panelcast.operators.moments import CELL_BUDGET, column_means, gram, gram_matrix, key_groups, matrix, per_group
from panelcast.operators.ordering import join_dates, ranged_totals
from panelcast.operators.splits import hash_uniform, repeated_kfold
from panelcast.session import cut_lineage


#: Share of the rows that a bootstrap sample leaves out.
UNDRAWN = 0.36787944117144233


@dataclass(frozen=True)
class KFold:
    """``repeats`` divisions of the rows into ``k`` folds by a hash of ``keys``, as ``splits.repeated_kfold`` draws them."""

    keys: Sequence[str]
    k: int = 5
    repeats: int = 1
    seed: int = 42


@dataclass(frozen=True)
class Bootstrap:
    """``replicates`` samples with the Poisson weights of ``splits.bootstrap``; rows of weight zero are the test set."""

    keys: Sequence[str]
    replicates: int = 25
    seed: int = 42


def poisson_weights(u: np.ndarray) -> np.ndarray:
    """Poisson(1) draws from uniforms, by the same steps as ``splits.bootstrap``."""
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 20):
        total += p
        steps.append(total)
        p /= k
    return np.searchsorted(np.array(steps), u, side="right").astype(float)


def calendar_blocks(df: DataFrame, windows: DataFrame, idx: str = "idx") -> tuple[DataFrame, dict[tuple[int, str], tuple[int, int]]]:
    """(table idx to block, blocks (first, last) of each (fold, role)): the index is cut where a window begins or has ended."""
    edge = windows.select(F.explode(F.array(F.col("lo").cast("long"), F.col("hi").cast("long") + 1)).alias(idx)).distinct().withColumn("_edge", F.lit(1))
    dates = df.select(F.col(idx).cast("long").alias(idx)).where(F.col(idx).isNotNull()).distinct().withColumn("_edge", F.lit(0))
    numbered = cut_lineage(ranged_totals(edge.unionByName(dates), [], [F.asc(idx), F.desc("_edge")], F.col("_edge"), "block"))
    at = numbered.where("_edge = 1").drop("_edge")
    first, last = at.select(F.col(idx).alias("lo"), F.col("block").alias("first")), at.select((F.col(idx) - 1).alias("hi"), (F.col("block") - 1).alias("last"))
    spans = windows.select("fold", "role", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).join(first, "lo").join(last, "hi")
    # two rows a fold, and no more folds than dates
    return numbered.where("_edge = 0").drop("_edge"), {(r["fold"], r["role"]): (r["first"], r["last"]) for r in spans.collect()}


def _schema(names: Sequence[str]) -> T.StructType:
    long, double = T.LongType(), T.DoubleType()
    return T.StructType([
        T.StructField("fold", T.IntegerType()), T.StructField("point", T.IntegerType()), *[T.StructField(n, double) for n in names], COEF,
        T.StructField("n_train", long), T.StructField("n_test", long), T.StructField("mse_train", double), T.StructField("mse_test", double),
    ])


def _solved(folds: Iterator[tuple[int, np.ndarray, np.ndarray]], grid: Sequence[Mapping[str, float]], kind: str, shift: Sequence[float], names: Sequence[str]) -> pd.DataFrame:
    """One row for each fold with training rows and each point."""
    rows = []
    for fold, train, test in folds:
        if train[0, 0] <= 0.5:  # counts are whole; differences of running totals leave rounding
            continue
        for k, point in enumerate(grid):
            coef = solve_moments(train, kind, point, shift)
            known = test[0, 0] > 0.5
            rows.append([fold, k, *[float(point[m]) if m in point else None for m in names], coef, int(round(train[0, 0])), int(round(test[0, 0])),
                         mse_of(train, coef, shift), mse_of(test, coef, shift) if known else None])
    return pd.DataFrame(rows, columns=_schema(names).names)


def window_search(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str], windows: DataFrame, kind: str = "ridge", idx: str = "idx"
) -> DataFrame:
    """Every (group, fold, point) of fold windows (fold, role train or test, lo, hi) over the row index.

    Moments are summed once for each group and calendar block; each window is the difference of two running totals, so
    overlapping windows cost nothing. A group's blocks (at most two for each window edge) are solved in one task.
    """
    blocks, spans = calendar_blocks(df, windows, idx)
    size, shift = len(xs) + 2, column_means(df, [*xs, y])
    cells = gram(join_dates(df, blocks, idx), [*xs, y], [*by, "block"], shift)
    names, folds = sorted({k for point in grid for k in point}), sorted({fold for fold, _ in spans})
    count = max((last for _, last in spans.values()), default=0)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        run = np.zeros((count + 2, size, size))
        inside = pdf[pdf["block"] <= count]
        run[inside["block"].to_numpy() + 1, inside["i"].to_numpy(), inside["j"].to_numpy()] = inside["s"].to_numpy(dtype=float)
        run = np.cumsum(run, axis=0)

        def moments(span: tuple[int, int] | None) -> np.ndarray:
            if span is None:
                return np.zeros((size, size))
            m = run[span[1] + 1] - run[span[0]]
            return np.triu(m) + np.triu(m, 1).T

        return _solved(((f, moments(spans.get((f, "train"))), moments(spans.get((f, "test")))) for f in folds), grid, kind, shift, names)

    points = cut_lineage(per_group(cells, by, solve, _schema(names)))
    tested = range_join_folds(df, windows.where("role = 'test'").select(F.col("fold").cast("int").alias("fold"), "role", "lo", "hi"), idx)
    return points.join(score_points(tested, y, xs, points, [*by, "fold"], [*by, "fold"]).withColumnRenamed("mae", "mae_test"), [*by, "fold", "point"], "left")


def sample_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str], folds: KFold | Bootstrap, shift: Sequence[float]) -> DataFrame:
    """(by..., sample, i, j, s): moments of every fold (repeat x k + fold), or of every replicate and then of the rows each leaves out.

    A batch is one matrix product of the samples' weights and the rows' products, so rows are never copied for each sample.
    """
    by, p = list(by), len(cols)
    draws = folds.repeats if isinstance(folds, KFold) else folds.replicates
    width = draws * folds.k if isinstance(folds, KFold) else 2 * draws
    i, j = np.triu_indices(p + 1)
    schema = T.StructType([df.schema[b] for b in by] + [T.StructField("sample", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType()))])
    keep = max(1, CELL_BUDGET // (width * len(i)))

    def weights(u: np.ndarray) -> np.ndarray:
        if isinstance(folds, KFold):
            own = np.minimum(np.floor(u * folds.k).astype(int), folds.k - 1) + np.arange(draws) * folds.k
            out = np.zeros((len(u), width))
            np.put_along_axis(out, own, 1.0, axis=1)
            return out
        w = poisson_weights(u)
        return np.hstack([w, w == 0])

    def rows(held: dict, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, m in held.items():
            out = [pa.array([v] * width, kinds.field(b).type) for b, v in zip(by, key, strict=True)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.arange(width, dtype="int32")), pa.array(list(m), pa.list_(pa.float64()))], [*by, "sample", "row"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            x, u = matrix(batch.column("_x")), matrix(batch.column("_u"))
            whole = ~np.isnan(x).any(axis=1)
            for group, at in key_groups(batch, by):
                key, at = tuple(group.values()), at[whole[at]]
                if not len(at):
                    continue
                z = np.column_stack([np.ones(len(at)), x[at]])
                m = weights(u[at]).T @ (z[:, i] * z[:, j])
                held[key] = held[key] + m if key in held else m
                if len(held) >= keep:
                    yield from rows(held, batch.schema)
                    held = {}
        if held:
            yield from rows(held, batch.schema)

    x = [F.col(c).cast("double") - F.lit(float(s)) for c, s in zip(cols, shift, strict=True)]
    u = [hash_uniform(folds.keys, r, folds.seed) for r in range(draws)]
    parts = df.select(*by, F.array(*x).alias("_x"), F.array(*u).alias("_u")).mapInArrow(partial, schema)
    at = F.array(*[F.struct(F.lit(int(a)).alias("i"), F.lit(int(b)).alias("j")) for a, b in zip(i, j, strict=True)])
    cells = parts.select(*by, "sample", F.posexplode("row").alias("_n", "s")).groupBy(*by, "sample", "_n").agg(F.sum("s").alias("s"))
    return cells.withColumn("_at", F.get(at, F.col("_n"))).select(*by, "sample", "_at.i", "_at.j", "s")


def fold_search(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str], folds: KFold | Bootstrap | str, kind: str = "ridge"
) -> DataFrame:
    """Every (group, fold, point): fitted on all rows outside the fold, tested on those inside; ``folds`` may name a column of fold numbers.

    The fold number of a repeated division is repeat x k + fold. For ``Bootstrap`` it is the replicate: fitted on its
    weighted rows, tested on those it leaves out. Rows with a null fold take no part.
    """
    by = list(by)
    size, shift = len(xs) + 2, column_means(df, [*xs, y])
    names = sorted({k for point in grid for k in point})
    if isinstance(folds, str):
        cells = gram(df.where(F.col(folds).isNotNull()).withColumn("sample", F.col(folds).cast("int")), [*xs, y], [*by, "sample"], shift)
        k, tested = None, df.where(F.col(folds).isNotNull()).withColumn("fold", F.col(folds).cast("int"))
    else:
        cells = sample_moments(df, [*xs, y], by, folds, shift)
        if isinstance(folds, KFold):
            k = folds.k
            tested = repeated_kfold(df.drop("repeat", "fold"), folds.keys, k, folds.repeats, folds.seed).withColumn("fold", F.col("repeat") * k + F.col("fold"))
        else:
            k = 0
            tested = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds.replicates - 1))))
            tested = tested.where(hash_uniform(folds.keys, F.col("fold"), folds.seed) < UNDRAWN)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {int(s): gram_matrix(part, size) for s, part in pdf.groupby("sample")}
        none = np.zeros((size, size))

        def pairs() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            if k == 0:
                for r in range(folds.replicates):
                    yield r, parts.get(r, none), parts.get(r + folds.replicates, none)
                return
            for s in sorted(parts):
                others = [m for t, m in parts.items() if k is None or t // k == s // k]
                yield s, sum(others, none) - parts[s], parts[s]

        return _solved(pairs(), grid, kind, shift, names)

    points = cut_lineage(per_group(cells, by, solve, _schema(names)))
    mae = None
    if not isinstance(folds, str):
        draws = range(folds.repeats if isinstance(folds, KFold) else folds.replicates)

        def fold_of(n: int, u: np.ndarray) -> np.ndarray:
            return n * k + np.floor(u * k).astype(int) if k else np.where(u < UNDRAWN, n, -1)

        mae = score_samples(df, y, xs, points, by, [hash_uniform(folds.keys, r, folds.seed) for r in draws], fold_of)
    if mae is None:
        mae = score_points(tested, y, xs, points, [*by, "fold"], [*by, "fold"])
    return points.join(mae.withColumnRenamed("mae", "mae_test"), [*by, "fold", "point"], "left")


def over_folds(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., point, folds, mean and deviation of the test errors) of a search."""
    out = [F.count("*").alias("folds")]
    for name in ("mse", "mae"):
        out += [F.avg(f"{name}_test").alias(name), F.stddev_samp(f"{name}_test").alias(f"{name}_sd")]
    return results.groupBy(*by, "point").agg(*out)
