"""Support-vector regression with the epsilon-insensitive loss, for every group and parameter point at once.

Minimises |b|^2 / 2 + cost * sum(max(0, |y - b0 - b'z(x)| - epsilon)), where z is x itself, random Fourier features of
the radial kernel, or monomials. A pass over the rows gives value and slope of all models together; quasi-Newton
steps are made on a loss whose corners are rounded off, and the rounding shrinks until the unrounded loss
is provably within ``tol`` of its minimum: every pass also gives a point of the dual problem, which
bounds the minimum from below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.models.grove import Held, _parts
from panelcast.operators.models.linear import COEF
from panelcast.session import remove_scratch, scratch_path

#: Passes until every model must have settled.
PASSES = 600
#: Steps whose value is looked at in one pass.
STEPS = (1.0, 0.25, 0.03125)
#: Earlier steps that shape the next one.
MEMORY = 10
#: Sums of a model before those of its features.
SUMS = 6
#: Numbers of z, and of residuals of its models, worked on at a time, so that they stay in a core's cache.
STEP = 1 << 16
#: Bytes of a block of rows; a batch that a task reads holds thousands of blocks.
BLOCK = 4096


def feature_map(point: Mapping, p: int, size: int = 64, seed: int = 42):
    """z of a point: ``sigma`` for the radial kernel exp(-sigma |x - x'|^2), ``degree`` and ``scale`` for monomials, else x."""
    if "sigma" in point:
        rng = np.random.default_rng(seed)
        w, c = rng.normal(scale=np.sqrt(2 * float(point["sigma"])), size=(p, size)), rng.uniform(0, 2 * np.pi, size)
        return lambda x: np.sqrt(2.0 / size) * np.cos(x @ w + c)
    if "degree" in point:
        scale = float(point.get("scale", 1.0))
        terms = [list(t) for d in range(1, int(point["degree"]) + 1) for t in combinations_with_replacement(range(p), d)]
        return lambda x: np.stack([np.prod(scale * x[:, t], axis=1) for t in terms], axis=1)
    return lambda x: x


def map_key(point: Mapping) -> tuple:
    """Points with the same key share a feature map."""
    return tuple((k, float(point[k])) for k in ("sigma", "degree", "scale") if k in point)


def _moved(coef: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """(steps, points): models to work out at each step. Done ones have none, and one whose steps are the same place only the first."""
    moved = (coef != coef[:1]).any(axis=2)
    moved[0] = True
    return moved & ~np.isnan(mu)


def _add(out: np.ndarray, mine: np.ndarray, zz: np.ndarray, y: np.ndarray, b: np.ndarray, mu: np.ndarray, eps: np.ndarray, cost: np.ndarray, size: int) -> None:
    """Adds the sums of some rows to those of the models ``mine``; zz is (1 + features, rows), all others (models, ...)."""
    n = len(zz)
    r = y - b @ zz
    over = np.abs(r)
    over -= eps
    np.maximum(over, 0.0, out=over)
    pull = np.minimum(over, mu)  # slope of the rounded loss, times mu / cost
    loss = np.einsum("mi,mi->m", pull, over) - np.einsum("mi,mi->m", pull, pull) / 2
    pull *= cost / mu
    up = np.where(r > 0, pull, 0.0)
    pull -= up
    out[mine, 0] += loss * (cost / mu)[:, 0]
    out[mine, 1] += cost[:, 0] * over.sum(axis=1)
    out[mine, 2] += up @ y
    out[mine, 3] += pull @ y
    out[mine, 4] += np.einsum("mi,mi->m", up, up)
    out[mine, 5] += np.einsum("mi,mi->m", pull, pull)
    out[mine, SUMS : SUMS + n] += up @ zz.T
    out[mine, SUMS + size + 1 : SUMS + size + 1 + n] += pull @ zz.T


def _blocks(rows: DataFrame, p: int) -> tuple[DataFrame, str]:
    """``g, data``: the rows that have target and predictors, as stored blocks of numbers, and their path.

    Every pass reads them, and a block costs what a row would.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, BLOCK // (8 * (p + 1)))
        for g, part, _ in _parts(batches, p):
            known = ~np.isnan(part["y"]) & ~np.isnan(part["x"]).any(axis=1)
            m = np.column_stack([part["y"][known], part["x"][known]])
            data = [m[at : at + at_once].tobytes() for at in range(0, len(m), at_once)]
            if data:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), g, "int64")), pa.array(data, pa.binary())], ["g", "data"])

    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "tube")
    rows.mapInArrow(pack, "g long, data binary").write.parquet(path)
    return spark.read.schema("g long, data binary").parquet(path), path


def _unpacked(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, x, y) of the blocks of a group that follow one another in a batch."""
    for batch in batches:
        g = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)] if len(g) else []
        for a, b in zip(cuts, cuts[1:]):
            m = np.frombuffer(b"".join(batch.column(1).slice(a, b - a).to_pylist())).reshape(-1, 1 + p)
            yield int(g[a]), m[:, 1:], m[:, 0]


def _totals(rows: DataFrame, shared, p: int, size: int, width: int) -> dict[int, np.ndarray]:
    """Sums of all models of each group over the blocks ``rows``: (steps, models, width) numbers a group reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, points, maps = shared.value
        held: dict[int, np.ndarray] = {}
        eps, cost = (np.array([float(q[c]) for q in points]) for c in ("epsilon", "cost"))
        for g, x, y in _unpacked(batches, p):
            if g not in state:
                continue
            coef, mu = state[g]  # (steps, points, 1 + size), (points)
            out = held.setdefault(g, np.zeros((len(coef), coef.shape[1], width)))
            moved = _moved(coef, mu)
            for key in dict.fromkeys(maps):
                of_map = np.array([m == key for m in maps])
                tries = [(t, mine) for t, mine in enumerate(np.flatnonzero(which & of_map) for which in moved) if len(mine)]
                if not tries:
                    continue
                z = feature_map(dict(key), p, size)
                rows_at_once = max(64, STEP // max(len(tries[0][1]), len(z(np.zeros((1, p)))[0]) + 1))
                for at in range(0, len(y), rows_at_once):
                    zz = z(x[at : at + rows_at_once])
                    zz = np.concatenate([np.ones((1, len(zz))), zz.T])
                    n = len(zz)
                    for t, mine in tries:
                        _add(out[t], mine, zz, y[at : at + rows_at_once], coef[t, mine, :n], mu[mine, None], eps[mine, None], cost[mine, None], size)
        for g, out in held.items():
            coef, mu = state[g]
            for t, which in enumerate(_moved(coef, mu)[1:], 1):
                out[t, ~which] = out[0, ~which]
        for g, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([m.tobytes()], pa.binary())], ["g", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for g, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["g", "sums"])
                    now, total = g, np.zeros(len(sums) // 8)
                total += np.frombuffer(sums, dtype=float)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["g", "sums"])

    schema = "g long, sums binary"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.mapInArrow(partial, schema).repartition(parts, "g").sortWithinPartitions("g").mapInArrow(added, schema)
    return {r["g"]: np.frombuffer(r["sums"], dtype=float) for r in sums.collect()}


class Descent:
    """Limited-memory quasi-Newton steps of many models side by side, on the driver: a few numbers for each model."""

    def __init__(self, start: np.ndarray, mu: np.ndarray) -> None:
        n = len(start)
        self.at, self.mu = start, mu
        self.slope, self.value = np.zeros(start.shape), np.full(n, np.inf)
        self.move, self.scale = np.zeros(start.shape), np.ones(n)
        self.fresh, self.steps = np.ones(n, dtype=bool), np.zeros(n, dtype=int)  # fresh: value and slope are still to be found
        self.s: list[np.ndarray] = []
        self.d: list[np.ndarray] = []

    def tries(self) -> np.ndarray:
        """(steps, models, numbers): the places to look at."""
        move = np.where(self.fresh[:, None], 0.0, self.scale[:, None] * self.move)
        return np.stack([self.at + t * move for t in STEPS])

    def direction(self) -> np.ndarray:
        """Where each model should go, from its slope and its last steps."""
        q, used = self.slope.copy(), []
        gamma = np.full(len(q), np.nan)
        for s, d in zip(reversed(self.s), reversed(self.d), strict=True):
            curve = (s * d).sum(axis=1)
            rho = np.where(curve > 0, 1 / np.where(curve > 0, curve, 1), 0)
            newest = np.isnan(gamma) & (rho > 0)
            gamma[newest] = curve[newest] / (d[newest] ** 2).sum(axis=1)
            a = rho * (s * q).sum(axis=1)
            q -= a[:, None] * d
            used.append((s, d, rho, a))
        length = np.sqrt((self.slope**2).sum(axis=1))
        q *= np.where(np.isnan(gamma), np.maximum(np.sqrt((self.at**2).sum(axis=1)), 1e-3) / np.maximum(length, 1e-300), gamma)[:, None]
        for s, d, rho, a in reversed(used):
            q += s * (a - rho * (d * q).sum(axis=1))[:, None]
        return -q

    def take(self, tries: np.ndarray, value: np.ndarray, slope: np.ndarray, live: np.ndarray) -> None:
        """Goes on from the longest step that lowers the value by a share of what the slope promises."""
        promise = (self.slope * self.move).sum(axis=1) * self.scale
        ok = np.stack([value[t] <= self.value + 1e-4 * step * promise for t, step in enumerate(STEPS)]) & (promise < 0)
        hit, which, at = ok.any(axis=0) & live & ~self.fresh, np.argmax(ok, axis=0), np.arange(len(live))
        new, new_slope = tries[which, at], slope[which, at]
        self.s = [*self.s, np.where(hit[:, None], new - self.at, 0.0)][-MEMORY:]
        self.d = [*self.d, np.where(hit[:, None], new_slope - self.slope, 0.0)][-MEMORY:]
        begun = live & self.fresh
        for kept in (*self.s, *self.d):
            kept[begun] = 0.0
        self.at, self.value = np.where(hit[:, None], new, self.at), np.where(hit, value[which, at], np.where(begun, value[0], self.value))
        self.slope = np.where(hit[:, None], new_slope, np.where(begun[:, None], slope[0], self.slope))
        self.steps = np.where(begun, 0, self.steps + hit)
        self.move = np.where((hit | begun)[:, None], self.direction(), self.move)
        self.scale = np.where(hit | begun, 1.0, self.scale * STEPS[-1] / 4)
        self.fresh = self.fresh & ~begun

    def shrink(self, which: np.ndarray) -> None:
        """Less rounding for these models; their value and slope are to be found again."""
        self.mu = np.where(which, self.mu / 4, self.mu)
        self.fresh = self.fresh | which


def settle(evaluate: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, mu: np.ndarray, cost: np.ndarray, epsilon: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coef, objective, bound) of every model: steps from ``start`` until each objective is within ``tol`` of its lower bound.

    ``evaluate(tries, mu)`` gives the sums of ``_totals`` for (steps, models, numbers); models with a NaN for mu are done.
    """
    run, size = Descent(start, mu), start.shape[1] - 1
    best, objective, bound = start.copy(), np.full(len(start), np.inf), np.full(len(start), -np.inf)
    done, floor = np.zeros(len(start), dtype=bool), np.full(len(start), -np.inf)
    for _ in range(PASSES):
        if done.all():
            return best, objective, bound
        tries, live = run.tries(), ~done
        sums = evaluate(tries, np.where(live, run.mu, np.nan))
        up, down = sums[:, :, SUMS : SUMS + 1 + size], sums[:, :, SUMS + 1 + size :]
        half = (tries[:, :, 1:] ** 2).sum(axis=2) / 2
        value, exact = half + sums[:, :, 0], half + sums[:, :, 1]
        slope = down - up
        slope[:, :, 1:] += tries[:, :, 1:]
        # a dual point: the pulls up and down, the larger scaled so that they add up to nothing
        u, d = up[:, :, 0], down[:, :, 0]
        tu, td = np.minimum(1, d / np.maximum(u, 1e-300)), np.minimum(1, u / np.maximum(d, 1e-300))
        w = tu[..., None] * up[:, :, 1:] - td[..., None] * down[:, :, 1:]
        dual = -(w**2).sum(axis=2) / 2 + tu * sums[:, :, 2] - td * sums[:, :, 3] - epsilon * (tu * u + td * d)
        # the same point bounds the rounded problem, too
        rounded = dual - run.mu / (2 * cost) * (tu * tu * sums[:, :, 4] + td * td * sums[:, :, 5])
        for t in range(len(tries)):
            better = live & (exact[t] < objective)
            best[better], objective[better] = tries[t][better], exact[t][better]
            bound = np.where(live, np.maximum(bound, dual[t]), bound)
        run.take(tries, value, slope, live)
        gap = objective - bound
        done |= gap <= tol * np.abs(objective) + 1e-12
        # once the rounded problem is as good as solved, what is left is due to the rounding
        floor = np.where(run.steps == 0, -np.inf, floor)
        floor = np.where(live, np.maximum(floor, rounded.max(axis=0)), floor)
        run.shrink(~done & ~run.fresh & ((run.value - floor <= 0.2 * gap) | (run.scale < 1e-7)))
    if done.all():
        return best, objective, bound
    raise ArithmeticError(f"{int((~done).sum())} models have not settled after {PASSES} passes")


def _slice_models(rows: DataFrame, groups: list[int], points: Sequence[Mapping], p: int, size: int, tol: float) -> dict[int, tuple[np.ndarray, ...]]:
    """Group to (coef, objective, bound) by point, after passes over ``rows`` until all have settled."""
    spark, k = rows.sparkSession, len(points)
    maps = [map_key(q) for q in points]
    rows = rows.where("split = 'train'")
    known = rows.where(~F.isnan("y") & ~F.exists("x", F.isnan)).groupBy("g")
    base = {r["g"]: (r["m"], r["s"]) for r in known.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).collect()}
    groups = [g for g in groups if g in base]
    start = np.zeros((len(groups) * k, 1 + size))
    start[:, 0] = np.repeat([base[g][0] for g in groups], k)
    width = SUMS + 2 * (size + 1)
    blocks, path = _blocks(rows, p)

    def evaluate(tries: np.ndarray, mu: np.ndarray) -> np.ndarray:
        parts = {g: slice(i * k, (i + 1) * k) for i, g in enumerate(groups)}
        state = {g: (tries[:, at], mu[at]) for g, at in parts.items() if not np.isnan(mu[at]).all()}
        shared = spark.sparkContext.broadcast((state, list(points), maps))
        found = _totals(blocks, shared, p, size, width)
        shared.unpersist()
        sums = np.zeros((len(tries), len(start), width))
        for g, m in found.items():
            sums[:, parts[g]] = m.reshape(len(tries), k, width)
        return sums

    cost, epsilon = (np.tile([float(q[c]) for q in points], len(groups)) for c in ("cost", "epsilon"))
    best, objective, bound = settle(evaluate, start, 0.25 * np.repeat([max(base[g][1], 1e-9) for g in groups], k), cost, epsilon, tol)
    remove_scratch(spark, path)
    return {g: (best[i * k : (i + 1) * k], objective[i * k : (i + 1) * k], bound[i * k : (i + 1) * k]) for i, g in enumerate(groups)}


def _sizes(points: Sequence[Mapping], p: int, size: int) -> int:
    """Numbers in the widest z."""
    return max(feature_map(dict(key), p, size)(np.zeros((1, p))).shape[1] for key in {map_key(q) for q in points})


def tube_fit(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], points: Sequence[Mapping], keys: Sequence[str], split: str | None = None,
    size: int = 64, tol: float = 1e-3, held: Held | None = None,
) -> DataFrame:
    """``(by..., point, coef, objective, bound)`` of every group and point (cost, epsilon; sigma, or degree and scale, for a feature map).

    Fitted on the rows of split ``train`` that have target and predictors. ``bound`` is below the least objective
    there is, and ``objective`` at most ``tol`` above it, relative to its size; models that are not
    there after PASSES raise. ``coef`` is [intercept, b...] on the features z, put predictors on one scale before.
    A pass reads the stored rows once for all models of a slice of groups; only sums leave a task. A group
    without such rows has no model.
    """
    width = _sizes(points, len(xs), size)
    held = held or Held(df, y, xs, by, keys, len(points) * (width + 1) * (len(STEPS) + 2 * MEMORY), split)
    out = []
    for s in range(held.slices):
        rows, named = held.slice(s)
        for g, (coef, objective, bound) in _slice_models(rows, sorted(named), points, len(xs), width, tol).items():
            for k, q in enumerate(points):
                n = feature_map(q, len(xs), size)(np.zeros((1, len(xs)))).shape[1]
                out.append((*named[g], k, coef[k, : n + 1].tolist(), float(objective[k]), float(bound[k])))
        if held.slices > 1:
            _frame(held, out).write.mode("append").parquet(path := f"{held.path}-models")
            out = []
    return _frame(held, out) if held.slices == 1 else held.spark.read.parquet(path)


def _frame(held: Held, rows: list[tuple]) -> DataFrame:
    by = [f"{f.name} {f.dataType.simpleString()}" for f in held.groups.select(*held.by).schema]
    return held.spark.createDataFrame(rows, ", ".join([*by, "point int", f"coef {COEF.dataType.simpleString()}", "objective double", "bound double"]))


def tube_scores(held: Held, models: DataFrame, points: Sequence[Mapping], size: int = 64) -> DataFrame:
    """``(by..., point, split, n, mse, mae)`` of the models on the rows of each split that have target and predictors."""
    out, p = [], held.p
    maps = [map_key(q) for q in points]
    for s in range(held.slices):
        rows, named = held.slice(s)
        mine = held.groups.where(F.col("_s") == s).select(*held.by)
        kept: dict[tuple, list] = {}
        for r in (models.join(F.broadcast(mine), held.by, "left_semi") if held.slices > 1 else models).collect():
            kept.setdefault(tuple(r[b] for b in held.by), []).append((r["point"], np.array(r["coef"])))
        shared = held.spark.sparkContext.broadcast({g: kept[key] for g, key in named.items() if key in kept})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple, np.ndarray] = {}
            for g, part, _ in _parts(batches, p):
                known = ~np.isnan(part["y"]) & ~np.isnan(part["x"]).any(axis=1)
                if g not in shared.value or not known.any():
                    continue
                split = np.array(part["split"].to_pylist(), dtype=object)[known]
                z = {key: feature_map(dict(key), p, size)(part["x"][known]) for key in {maps[k] for k, _ in shared.value[g]}}
                for k, coef in shared.value[g]:
                    err = part["y"][known] - coef[0] - z[maps[k]] @ coef[1:]
                    for name in set(split):
                        e = err[split == name]
                        sums[g, k, name] = sums.get((g, k, name), 0) + np.array([len(e), e @ e, np.abs(e).sum()])
            if sums:
                g, k, name = zip(*sums, strict=True)
                n, sq, ab = np.array(list(sums.values())).T
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int32()), pa.array(name, pa.string()), pa.array(n), pa.array(sq), pa.array(ab)], ["g", "point", "split", "n", "sq", "ab"])

        schema = "g long, point int, split string, n double, sq double, ab double"
        out.append(rows.mapInArrow(run, schema).groupBy("g", "point", "split").agg(*[F.sum(c).alias(c) for c in ("n", "sq", "ab")]))
    every = reduce(DataFrame.union, out).withColumnRenamed("g", "_g").join(held.groups, "_g")
    return every.select(*held.by, "point", "split", F.col("n").cast("long").alias("n"), (F.col("sq") / F.col("n")).alias("mse"), (F.col("ab") / F.col("n")).alias("mae"))


def tube_search(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], points: Sequence[Mapping], keys: Sequence[str], split: str = "split", size: int = 64, tol: float = 1e-3
) -> tuple[DataFrame, DataFrame]:
    """(models, metrics by split) of every group and point, from rows stored once."""
    held = Held(df, y, xs, by, keys, len(points) * (_sizes(points, len(xs), size) + 1) * (len(STEPS) + 2 * MEMORY), split)
    models = tube_fit(df, y, xs, by, points, keys, split, size, tol, held)
    return models, tube_scores(held, models, points, size)


def tube_refit(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str], points: Sequence[Mapping], keys: Sequence[str], tried: DataFrame, split: str = "split",
    size: int = 64, tol: float = 1e-3,
) -> tuple[DataFrame, DataFrame]:
    """(model of each group's best point refitted on train and val, its metrics by split); ``tried`` are metrics of ``tube_search``.

    The best point has the least MSE on split ``val``, then the lowest number.
    """
    both = df.withColumn(split, F.when(F.col(split).isin("train", "val"), "train").otherwise(F.col(split)))
    best = tried.where("split = 'val'").groupBy(*by).agg(F.min(F.struct("mse", "point"))["point"].alias("point"))
    held = Held(both, y, xs, by, keys, len(points) * (_sizes(points, len(xs), size) + 1) * (len(STEPS) + 2 * MEMORY), split)
    models = tube_fit(both, y, xs, by, points, keys, split, size, tol, held).join(best, [*by, "point"])
    return models, tube_scores(held, models, points, size)
