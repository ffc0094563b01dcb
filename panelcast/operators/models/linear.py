"""Linear models of every group in one job, all solved from second moments.

A model is a row ``(by..., coef)`` with ``coef = [intercept, b1, ..., bp]`` in the order of the predictors.
The data is read once per fit; a solver only ever sees the p x p moments of its group.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.joins import join_groups
from panelcast.operators.moments import CELL_BUDGET, column_means, gram, gram_matrix, key_groups, matrix, per_group, plain
from panelcast.operators.splits import hash_uniform
from panelcast.session import cut_lineage

COEF = T.StructField("coef", T.ArrayType(T.DoubleType()))


# ---- solvers on standardised moments: r = X'X / n, c = X'y / n ----


def _ols(r, c, p):
    return np.linalg.lstsq(r, c, rcond=1e-11)[0]


def _ridge(r, c, p):
    return np.linalg.solve(r + (float(p["lambda"]) + 1e-12) * np.eye(len(c)), c)


def _elastic_net(r, c, p, sweeps: int = 1_000_000, tol: float = 1e-10):
    """Coordinate descent on 1/2n |y - Xb|^2 + lambda (alpha |b|_1 + (1 - alpha) / 2 |b|^2); raises if it does not settle."""
    l1, l2 = p["lambda"] * p["alpha"], p["lambda"] * (1 - p["alpha"])
    b = np.zeros(len(c))
    for _ in range(sweeps):
        move = 0.0
        for j in range(len(c)):
            rho = c[j] - r[j] @ b + r[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (r[j, j] + l2) if r[j, j] + l2 > 0 else 0.0
            move = max(move, abs(new - b[j]))
            b[j] = new
        if move < tol:
            return b
    raise ArithmeticError(f"elastic net: moves of {move:g} after {sweeps} sweeps")


def _boost(r, c, p):
    """Component-wise L2 boosting: one small step along the best column at a time."""
    b, left, diag = np.zeros(len(c)), c.astype(float).copy(), np.where(np.diag(r) > 0, np.diag(r), np.inf)
    for _ in range(int(p["steps"])):
        j = int(np.argmax(left * left / diag))
        step = p["rate"] * left[j] / diag[j]
        b[j] += step
        left -= step * r[:, j]
    return b


def _pls(r, c, p):
    """PLS1 from moments: weights from the remaining covariance, then deflation."""
    s, S, ws, ps, qs = c.astype(float).copy(), r.astype(float).copy(), [], [], []
    for _ in range(min(int(p["ncomp"]), len(c))):
        norm = np.linalg.norm(s)
        if norm < 1e-12:
            break
        w = s / norm
        t2 = w @ S @ w
        if t2 < 1e-12:
            break
        load, q = S @ w / t2, (s @ w) / t2
        S = S - t2 * np.outer(load, load)
        s = s - t2 * q * load
        ws.append(w)
        ps.append(load)
        qs.append(q)
    if not ws:
        return np.zeros(len(c))
    W, P = np.array(ws).T, np.array(ps).T
    return W @ np.linalg.solve(P.T @ W, np.array(qs))


SOLVERS = {"ols": _ols, "ridge": _ridge, "elastic_net": _elastic_net, "boost": _boost, "pls": _pls}


def solve_moments(g: np.ndarray, kind: str, params: Mapping[str, float], shift: Sequence[float]) -> np.ndarray:
    """Coefficients on the original scale from the sums of ``[1, x..., y]`` (shifted by ``shift``)."""
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
    live = sd > 1e-9 * (1.0 + np.abs(mean[:-1] + np.asarray(shift[:-1])))
    scale = np.where(live, sd, 1.0)
    r = cov[:-1, :-1] / np.outer(scale, scale)
    c = cov[:-1, -1] / scale
    b = np.zeros(len(c))
    if live.any():
        at = np.flatnonzero(live)
        b[at] = SOLVERS[kind](r[np.ix_(at, at)], c[at], params) / scale[at]
    full_mean = mean + np.asarray(shift)
    return np.concatenate([[full_mean[-1] - b @ full_mean[:-1]], b])


def mse_of(g: np.ndarray, coef: np.ndarray, shift: Sequence[float]) -> float:
    """Mean squared error of a model on the rows behind ``g``, without another data pass."""
    if g[0, 0] <= 0:
        return float("nan")
    sh = np.asarray(shift)
    v = np.concatenate([[-(coef[0] + coef[1:] @ sh[:-1] - sh[-1])], -coef[1:], [1.0]])
    return float(max(v @ g @ v, 0.0) / g[0, 0])


def param_grid(**lists: Sequence) -> list[dict]:
    """Cartesian grid of hyper-parameters."""
    names = list(lists)
    return [dict(zip(names, point)) for point in itertools.product(*lists.values())]


# ---- fitting and scoring ----


def fit(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), kind: str = "ols", params: Mapping | None = None) -> DataFrame:
    """One model per group: ``(by..., n, coef)``."""
    size, shift = len(xs) + 2, column_means(df, [*xs, y])
    params = dict(params or {})

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        g = gram_matrix(cells, size)
        return pd.DataFrame({"n": [int(g[0, 0])], "coef": [solve_moments(g, kind, params, shift)]})

    schema = T.StructType([T.StructField("n", T.LongType()), COEF])
    return per_group(gram(df, [*xs, y], by, shift), by, solve, schema)


def predict(df: DataFrame, models: DataFrame, xs: Sequence[str], by: Sequence[str] = (), name: str = "prediction") -> DataFrame:
    """Score rows with the model of their group (a column expression after a join on the group)."""
    if by:
        joined = join_groups(df, models.select(*by, "coef"), by, len(xs) + 1)
    else:
        joined = df.withColumn("coef", models.select("coef").scalar())
    return joined.withColumn(name, linear_score("coef", xs)).drop("coef")


def linear_score(coef: str, xs: Sequence[str]) -> Column:
    """Intercept plus products in the order of the predictors; one flat expression for any number of them."""
    if not xs:
        return F.col(coef)[0]
    values = F.array(*[F.col(x).cast("double") for x in xs])
    return F.aggregate(F.zip_with(F.slice(coef, 2, len(xs)), values, lambda b, x: b * x), F.col(coef)[0], lambda s, v: s + v)


def fit_grid(
    df: DataFrame, y: str, xs: Sequence[str], grid: Sequence[Mapping[str, float]], by: Sequence[str] = (), kind: str = "ridge",
    split: str = "split", timed: bool = False,
) -> DataFrame:
    """Every (group, parameter point) fitted on split ``train``: coefficients, MSE on train and val.

    All points are solved from the same two moment tables, so the grid size costs no data pass. ``timed`` adds when
    each fit started (seconds since 1970) and how many seconds it took, taken where it is solved.
    """
    size, shift = len(xs) + 2, column_means(df, [*xs, y])
    cells = gram(df.where(F.col(split).isin("train", "val")), [*xs, y], [*by, split], shift)
    names = sorted({k for point in grid for k in point})
    clock = ["started", "seconds"] if timed else []

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, va = (gram_matrix(pdf[pdf[split] == s], size) for s in ("train", "val"))
        columns = ["point", *names, "coef", "mse_train", "mse_val", *clock]
        if tr[0, 0] == 0:
            return pd.DataFrame(columns=columns)
        rows = []
        for k, point in enumerate(grid):
            started, t0 = time.time(), time.perf_counter()
            coef = solve_moments(tr, kind, point, shift)
            row = [k, *[float(point[m]) if m in point else None for m in names], coef, mse_of(tr, coef, shift), mse_of(va, coef, shift)]
            rows.append(row + [started, time.perf_counter() - t0] if timed else row)
        return pd.DataFrame(rows, columns=columns)

    schema = T.StructType(
        [T.StructField("point", T.IntegerType()), *[T.StructField(m, T.DoubleType()) for m in names], COEF,
         T.StructField("mse_train", T.DoubleType()), T.StructField("mse_val", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in clock]]
    )
    return per_group(cells, by, solve, schema)


#: Model numbers up to which all parameter points are sent to every task.
MODEL_NUMBERS = 8_000_000
#: Errors (rows x points) worked out at a time: they stay in the processor's cache.
ERRORS_AT_ONCE = 1 << 16


def score_points(df: DataFrame, y: str, xs: Sequence[str], points: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean absolute error per (by, point) of the models of each row's ``on`` group; rows with gaps (null or NaN) count nowhere.

    The models (as many numbers as groups x points x predictors, counted first) go to the tasks, where a
    batch of rows meets all points of its group in one matrix product; only sums leave a task. Beyond
    MODEL_NUMBERS the rows are joined to their models instead.
    """
    on, by, xs = list(on), list(by), list(xs)
    df = df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in [y, *xs]})
    models = cut_lineage(points.select(*on, "point", "coef"))
    if models.count() * (len(xs) + 1) > MODEL_NUMBERS:
        return _score_joined(df, y, xs, models, on, by)
    known = _as_matrices(models, on)
    shared = df.sparkSession.sparkContext.broadcast(known)
    keys, p = list(dict.fromkeys([*on, *by])), len(xs)
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField("point", T.IntegerType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Errors(by)
        for batch in batches:
            rows = _design(batch.column("_v"), p)
            for key, at in key_groups(batch, keys):
                look = tuple(plain(key[k]) for k in on)
                found = None if None in look else shared.value.get(look)  # rows without a group count nowhere
                part = rows[at]
                part = part[~np.isnan(part).any(axis=1)]
                if found is not None and len(part):
                    held.add(tuple(key[k] for k in by), *found, part)
            if held.cells > CELL_BUDGET:
                yield held.batch(batch.schema)
                held = _Errors(by)
        if held.sums:
            yield held.batch(batch.schema)

    rows = df.select(*keys, F.array(*[F.col(c).cast("double") for c in xs], F.col(y).cast("double")).alias("_v"))
    return _mean_errors(rows.mapInArrow(run, schema), by)


def score_samples(
    df: DataFrame, y: str, xs: Sequence[str], points: DataFrame, by: Sequence[str], draws: Sequence[Column], fold_of: Callable[[int, np.ndarray], np.ndarray]
) -> DataFrame | None:
    """Mean absolute error per (by, fold, point) on the rows that each fold tests; None where the models are too many for the tasks.

    ``draws`` are uniforms of a row; ``fold_of(n, u)`` tells the fold in which the n-th of them tests each row, or a negative
    number. Rows are read once and never copied for each fold.
    """
    by, xs, p = list(by), list(xs), len(xs)
    models = cut_lineage(points.select(*by, "fold", "point", "coef"))
    if models.count() * (p + 1) > MODEL_NUMBERS:
        return None
    shared = df.sparkSession.sparkContext.broadcast(_as_matrices(models, [*by, "fold"]))
    schema = T.StructType([df.schema[k] for k in by] + [T.StructField("fold", T.IntegerType()), T.StructField("point", T.IntegerType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Errors([*by, "fold"])
        for batch in batches:
            rows, u = _design(batch.column("_v"), p), matrix(batch.column("_u"))
            whole = ~np.isnan(rows).any(axis=1)
            for key, at in key_groups(batch, by):
                at = at[whole[at]]
                name, look = tuple(key[k] for k in by), tuple(plain(key[k]) for k in by)
                if None in look:
                    continue  # rows without a group count nowhere
                part = rows[at]
                for n in range(u.shape[1]):
                    fold = fold_of(n, u[at, n])
                    for f in np.unique(fold[fold >= 0]).tolist():
                        if (found := shared.value.get((*look, f))) is not None:
                            held.add((*name, f), *found, part[fold == f])
            if held.cells > CELL_BUDGET:
                yield held.batch(batch.schema)
                held = _Errors([*by, "fold"])
        if held.sums:
            yield held.batch(batch.schema)

    gap = F.lit(None).cast("double")
    v = F.array(*[F.nanvl(F.col(c).cast("double"), gap) for c in [*xs, y]])
    return _mean_errors(df.select(*by, v.alias("_v"), F.array(*draws).alias("_u")).mapInArrow(run, schema), [*by, "fold"])


def _as_matrices(models: DataFrame, on: Sequence[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Group to (points, models as columns over [1, x..., y])."""
    held: dict = {}
    for r in models.collect():
        held.setdefault(tuple(r[k] for k in on), []).append((r["point"], r["coef"]))
    return {
        k: (np.array([p for p, _ in v], dtype="int32"), np.vstack([np.array([c for _, c in v], dtype=float).T, np.full(len(v), -1.0)]))
        for k, v in ((k, sorted(v)) for k, v in held.items())
    }


def _design(column: pa.Array, p: int) -> np.ndarray:
    """[1, x..., y] of a column of arrays; nulls are NaN."""
    v = matrix(column).reshape(-1, p + 1)
    return np.column_stack([np.ones(len(v)), v])


class _Errors:
    """Sums of absolute errors by group and point; they stay in the task until it ends or holds too many."""

    def __init__(self, by: Sequence[str]) -> None:
        self.by, self.sums, self.cells = list(by), {}, 0

    def add(self, key: tuple, names: np.ndarray, models: np.ndarray, rows: np.ndarray) -> None:
        sums = np.zeros(len(names))
        step = max(16, ERRORS_AT_ONCE // len(names))
        for at in range(0, len(rows), step):
            e = rows[at : at + step] @ models
            sums += np.abs(e, out=e).sum(axis=0)
        key = (*key, names.tobytes())
        if key not in self.sums:
            self.sums[key] = [names, np.zeros(len(names)), 0]
            self.cells += len(names)
        self.sums[key][1] += sums
        self.sums[key][2] += len(rows)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        repeat = [len(v[0]) for v in self.sums.values()]
        kinds = [schema.field(k).type if k in schema.names else pa.int32() for k in self.by]
        at = np.repeat(np.arange(len(repeat)), repeat)
        cols = [pa.array([key[i] for key in self.sums], kind).take(pa.array(at)) for i, kind in enumerate(kinds)]
        names, sums = (np.concatenate([v[i] for v in self.sums.values()]) for i in (0, 1))
        n = np.repeat(np.array([v[2] for v in self.sums.values()], dtype=np.int64), repeat)
        return pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.int32()), pa.array(sums), pa.array(n)], [*self.by, "point", "_s", "_n"])


def _mean_errors(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = parts.groupBy(*by, "point").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return sums.select(*by, "point", (F.col("_s") / F.col("_n")).alias("mae"))


def _score_joined(df: DataFrame, y: str, xs: Sequence[str], models: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same by a join: errors are averaged map-side, so the row-by-model product is streamed and never stored."""
    joined = df.join(models, list(on)) if on else df.withColumn("_p", models.agg(F.collect_list(F.struct("point", "coef"))).scalar()).select("*", F.inline("_p")).drop("_p")
    err = F.abs(F.col(y) - linear_score("coef", xs))
    return joined.groupBy(*by, "point").agg(F.avg(err).alias("mae"))


def ridge_cv(
    df: DataFrame, y: str, xs: Sequence[str], lambdas: Sequence[float], keys: Sequence[str], by: Sequence[str], k: int = 5,
    seed: int = 42, shared_lambda: str | None = None,
) -> DataFrame:
    """Ridge per group with lambda of least cross-validated MAE; ``shared_lambda='mean'`` averages it over groups.

    Fold models come from the moments of the other folds; one scoring pass gives all their errors.
    """
    by = list(by)
    size, shift = len(xs) + 2, column_means(df, [*xs, y])
    folded = df.withColumn("fold", F.floor(hash_uniform(keys, seed) * k).cast("int"))
    cells = gram(folded, [*xs, y], [*by, "fold"], shift)

    def fold_paths(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {f: gram_matrix(part, size) for f, part in pdf.groupby("fold")}
        total = sum(parts.values())
        rows = [
            [int(f), i, solve_moments(total - g, "ridge", {"lambda": lam}, shift)]
            for f, g in parts.items() if (total - g)[0, 0] > 0
            for i, lam in enumerate(lambdas)
        ]
        return pd.DataFrame(rows, columns=["fold", "point", "coef"])

    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("point", T.IntegerType()), COEF])
    paths = per_group(cells, by, fold_paths, schema)
    errors = score_points(folded, y, xs, paths, [*by, "fold"], by)
    lam = F.get(F.array(*[F.lit(float(v)) for v in lambdas]), F.col("point"))
    chosen = errors.groupBy(*by).agg(F.min(F.struct("mae", "point")).alias("_b")).select(
        *by, F.col("_b.mae").alias("cv_mae"), F.col("_b.point").alias("point")
    ).withColumn("lambda", lam).drop("point")
    if shared_lambda == "mean":
        chosen = chosen.withColumn("lambda", chosen.agg(F.avg("lambda")).scalar())
    elif shared_lambda is not None:
        raise ValueError("shared_lambda is None or 'mean'")
    picked = cells.join(chosen, by) if by else cells.withColumn("lambda", chosen.select("lambda").scalar()).withColumn(
        "cv_mae", chosen.select("cv_mae").scalar())

    def refit(pdf: pd.DataFrame) -> pd.DataFrame:
        g = sum(gram_matrix(part, size) for _, part in pdf.groupby("fold"))
        value = float(pdf["lambda"].iloc[0])
        return pd.DataFrame({"n": [int(g[0, 0])], "lambda": [value], "cv_mae": [float(pdf["cv_mae"].iloc[0])],
                             "coef": [solve_moments(g, "ridge", {"lambda": value}, shift)]})

    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("lambda", T.DoubleType()),
                        T.StructField("cv_mae", T.DoubleType()), COEF])
    return per_group(picked, by, refit, out)
