"""Clustering of entities by their profile."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.aggregate import entity_profile, entity_profile_latest_year
from panelcast.operators.joins import zip_by_key
from panelcast.operators.preprocess import PCAThreshold, Scaler
from panelcast.operators.splits import hash_uniform
from panelcast.session import cut_lineage


def cluster_features(panel: DataFrame, dim: DataFrame, scale: bool = True, fit_until=None) -> DataFrame:
    """Profile, last-year profile and position per entity, centred and scaled.

    ``fit_until`` keeps later rows (the test period) out of the profile.
    """
    known = panel if fit_until is None else panel.where(F.col("ts") <= F.lit(fit_until).cast("date"))
    df = entity_profile(known).join(entity_profile_latest_year(known), "entity").join(dim, "entity")
    cols = [c for c in df.columns if c != "entity"]
    return Scaler.fit(df, cols).transform(df) if scale else df


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None, :]


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group, its vectors, their places) of a batch of ``grp, vec, ...``; the numbers are taken as they lie in the batch."""
    grp = np.asarray(batch.column(0))
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(grp), -1) if len(grp) else np.zeros((0, 0))
    for g in np.unique(grp):
        at = np.flatnonzero(grp == g)
        yield int(g), x if len(at) == len(grp) else x[at], at


def _spread(points: DataFrame, key: str) -> DataFrame:
    """``points`` stored in a part for every core: they are small beside the work that every pass does on them."""
    return cut_lineage(points.repartition(points.sparkSession.sparkContext.defaultParallelism, key))


def batch_kmeans(points: DataFrame, start: Mapping[tuple[int, int], np.ndarray], max_iter: int = 1000) -> tuple[dict, dict]:
    """Many k-means runs at once: ``points`` has ``grp int, vec array<double>``; ``start[(grp, run)]`` are (k, p) centres.

    Every iteration is one job for all runs: tasks add up counts and sums per (run, centre), only those
    sums (runs * k * p numbers) come back. Runs whose centres stay leave the job; runs that have not
    settled after ``max_iter`` raise. Returns the settled centres and their within sums of squares.
    """
    centers = {key: np.array(c, dtype=float) for key, c in start.items()}
    wss: dict = {}
    open_runs = set(centers)
    spark = points.sparkSession
    schema = "grp int, run int, c int, dim int, s double"
    for _ in range(max_iter):
        if not open_runs:
            return centers, wss
        by_group: dict = {}
        for g, run in sorted(open_runs):
            by_group.setdefault(g, []).append((run, centers[(g, run)]))
        shared = spark.sparkContext.broadcast(by_group)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            acc: dict = {}
            for batch in batches:
                for grp, x, _ in _by_group(batch):
                    if grp not in shared.value:
                        continue
                    for run, cen in shared.value[grp]:
                        d = _distances(x, cen)
                        who = d.argmin(1)
                        hot = np.eye(len(cen))[who]
                        part = np.column_stack([hot.sum(0), hot.T @ np.clip(d.min(1), 0, None), hot.T @ x])
                        acc[(grp, run)] = acc.get((grp, run), 0.0) + part
            for (g, run), m in acc.items():
                k, w = m.shape
                yield pa.RecordBatch.from_pydict({"grp": np.full(k * w, g, "int32"), "run": np.full(k * w, run, "int32"),
                                                  "c": np.repeat(np.arange(k, dtype="int32"), w), "dim": np.tile(np.arange(w, dtype="int32"), k),
                                                  "s": m.ravel()})

        sums = points.select("grp", "vec").mapInArrow(partial, schema).groupBy("grp", "run", "c", "dim").agg(F.sum("s").alias("s")).toPandas()
        shared.unpersist()
        for (g, run), part in sums.groupby(["grp", "run"]):
            m = part.pivot(index="c", columns="dim", values="s").sort_index().to_numpy()
            old = centers[(g, run)]
            new = np.where(m[:, :1] > 0, m[:, 2:] / np.maximum(m[:, :1], 1), old)
            wss[(g, run)] = float(m[:, 1].sum())
            if np.abs(new - old).max() <= 1e-9 * (1 + np.abs(old).max()):
                open_runs.discard((g, run))
            else:
                centers[(g, run)] = new
        open_runs &= {(int(g), int(run)) for g, run in zip(sums["grp"], sums["run"])}
    raise ArithmeticError(f"{len(open_runs)} k-means runs have not settled after {max_iter} steps")


def _vectors(df: DataFrame, cols: Sequence[str], key: str = "entity") -> DataFrame:
    return df.select(key, F.lit(0).alias("grp"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row hashes; another salt gives other numbers."""
    x = h.astype(np.int64).view(np.uint64) + np.uint64(salt & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0**-54


def starting_centers(points: DataFrame, runs: Mapping[tuple[int, int], int], key: str, seed: int, hashed: str | None = None) -> dict:
    """``runs[(grp, run)] = k`` starting centres, each drawn from all rows of the group with probability proportional to its squared distance so far.

    One job for each further centre of all runs: the row with the least -log(u) / weight wins, u being a
    hash of row, run and draw, so tasks hand on one row per run and nothing is sampled. ``hashed`` names a
    column that holds the row hashes already.
    """
    spark = points.sparkSession
    rows = points.select("grp", "vec", (F.col(hashed) if hashed else F.xxhash64("grp", key, F.lit(seed))).alias("h"))
    chosen: dict = {run: [] for run in runs}
    for draw in range(max(runs.values())):
        by_group: dict = {}
        for (g, run), k in sorted(runs.items()):
            if draw < k:
                by_group.setdefault(g, []).append((run, np.array(chosen[(g, run)])))
        shared = spark.sparkContext.broadcast(by_group)

        def partial(batches: Iterator[pa.RecordBatch], shared=shared, draw=draw) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for batch in batches:
                for grp, x, at in _by_group(batch):
                    if grp not in shared.value:
                        continue
                    h = np.asarray(batch.column(2))[at]
                    for run, so_far in shared.value[grp]:
                        weight = np.clip(_distances(x, so_far).min(1), 0, None) if len(so_far) else np.ones(len(x))
                        wait = -np.log(_uniform(h, run * 65_537 + draw + 1)) / np.maximum(weight, 1e-300)
                        i = int(wait.argmin())
                        if (grp, run) not in best or wait[i] < best[(grp, run)][0]:
                            best[(grp, run)] = (float(wait[i]), x[i])
            if best:
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([g for g, _ in best], pa.int32()), "run": pa.array([run for _, run in best], pa.int32()),
                    "wait": pa.array([w for w, _ in best.values()], pa.float64()), "vec": pa.array([v for _, v in best.values()], pa.list_(pa.float64())),
                })

        drawn = rows.mapInArrow(partial, "grp int, run int, wait double, vec array<double>").groupBy("grp", "run").agg(F.min_by("vec", "wait").alias("vec"))
        for r in drawn.collect():
            chosen[(r["grp"], r["run"])].append(np.array(r["vec"]))
        shared.unpersist()
    return {run: np.array(c) for run, c in chosen.items() if c}


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 8, nstart: int = 25, seed: int = 42, key: str = "entity") -> tuple[DataFrame, float]:
    """``(key, cluster 1..k)`` of the best of ``nstart`` starts, and its within sum of squares."""
    points = _spread(_vectors(df, cols, key), key)
    centers, wss = batch_kmeans(points, starting_centers(points, {(0, r): k for r in range(nstart)}, key, seed))
    best = min(wss, key=wss.get)
    final = centers[best][np.lexsort(centers[best].T[::-1])]  # numbered by position, not by chance

    def nearest(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, final.shape[1]))
        return pd.Series(_distances(x, final).argmin(1).astype("int32") + 1)

    labels = points.select(key, F.pandas_udf(nearest, T.IntegerType())("vec").alias("cluster"))
    return labels, wss[best]


def elbow(df: DataFrame, cols: Sequence[str], ks: Sequence[int], nstart: int = 5, seed: int = 42, key: str = "entity") -> DataFrame:
    """``(k, wss)``; all k and starts share the passes over the data."""
    points = _spread(_vectors(df, cols, key), key)
    runs = [(k, s) for k in ks for s in range(nstart)]
    _, wss = batch_kmeans(points, starting_centers(points, {(0, r): k for r, (k, _) in enumerate(runs)}, key, seed))
    best = {k: min(wss[(0, r)] for r, (kk, _) in enumerate(runs) if kk == k) for k in ks}
    return df.sparkSession.createDataFrame([(int(k), float(v)) for k, v in best.items()], "k int, wss double")


def silhouette(df: DataFrame, cols: Sequence[str], labels: str = "cluster", key: str = "entity") -> DataFrame:
    """Silhouette of every entity under squared Euclidean distance; 0 for a cluster of one.

    The mean squared distance of a point to a cluster follows from the cluster's count, sum and sum of
    squares, so no pair of entities is ever formed. The cluster table has k rows.
    """
    cols = list(cols)
    norm = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))
    table = df.groupBy(labels).agg(
        F.count("*").alias("n"), F.sum(norm).alias("q"), F.array(*[F.sum(c) for c in cols]).alias("s")
    )
    packed = table.agg(F.collect_list(F.struct(F.col(labels).alias("c"), "n", "q", "s"))).scalar()

    def total(cl: Column) -> Column:
        dot = sum((F.col(c) * cl["s"][i] for i, c in enumerate(cols)), F.lit(0.0))
        return cl["n"] * norm - 2 * dot + cl["q"]

    own = F.filter("_t", lambda cl: cl["c"] == F.col(labels))[0]
    a = F.when(own["n"] > 1, F.greatest(F.lit(0.0), total(own)) / (own["n"] - 1))
    others = F.transform(F.filter("_t", lambda cl: cl["c"] != F.col(labels)), lambda cl: F.greatest(F.lit(0.0), total(cl)) / cl["n"])
    out = df.withColumn("_t", packed).withColumn("_a", a).withColumn("_b", F.array_min(others))
    s = (F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0))
    return out.select(key, labels, F.when(F.col("_a").isNull(), 0.0).otherwise(F.coalesce(s, F.lit(0.0))).alias("silhouette"))


def gap_statistic(df: DataFrame, cols: Sequence[str], ks: Sequence[int], B: int = 500, seed: int = 123, nstart: int = 1, key: str = "entity") -> DataFrame:
    """``k, wss, gap, s``: mean log W of B uniform reference sets minus log W, s = sd * sqrt(1 + 1/B).

    Reference rows are drawn in the box of the principal axes by a hash of (row, set); all sets and all
    k are clustered together, from starts drawn by one rule. The sd is that of a sample.
    """
    spark = df.sparkSession
    pca = PCAThreshold.fit(df, cols, k=len(list(cols)))
    scores = pca.transform(df, [key])
    data = _vectors(scores, pca.names, key)
    box = scores.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(pca.names)],
                     *[F.max(c).alias(f"b{i}") for i, c in enumerate(pca.names)], F.count("*").alias("n")).first()
    p = len(pca.names)
    lo, hi = (np.array([box[f"{s}{i}"] for i in range(p)]) for s in "ab")
    ref = spark.range(box["n"] * B).select(
        F.col("id").alias(key), (F.col("id") % B + 1).cast("int").alias("grp"),
        F.array(*[F.lit(float(lo[i])) + hash_uniform(["id"], i, seed) * F.lit(float(hi[i] - lo[i])) for i in range(p)]).alias("vec"),
    )
    runs = [(k, s) for k in ks for s in range(nstart)]
    points = _spread(data.unionByName(ref), key)
    start = starting_centers(points, {(b, r): k for b in range(B + 1) for r, (k, _) in enumerate(runs)}, key, seed)
    _, wss = batch_kmeans(points, start)
    rows = []
    for k in ks:
        w = lambda b: min(wss[(b, r)] for r, (kk, _) in enumerate(runs) if kk == k)  # noqa: B023, E731
        logs = np.log([max(w(b), 1e-300) for b in range(1, B + 1)])
        rows.append((int(k), w(0), float(logs.mean() - np.log(max(w(0), 1e-300))), float(logs.std(ddof=1) * np.sqrt(1 + 1 / B))))
    return spark.createDataFrame(rows, "k int, wss double, gap double, s double")


def cluster_projection(df: DataFrame, cols: Sequence[str], labels: DataFrame, key: str = "entity") -> DataFrame:
    """Two-component view of the clusters."""
    return PCAThreshold.fit(df, cols, k=2).transform(df, [key]).join(labels, key)


def cluster_mean(panel: DataFrame, members: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Mean over the member entities per day, next to the features of that day."""
    mean = panel.join(members, "entity").groupBy("cluster", "ts").agg(F.avg("value").alias("value"))
    return mean if features is None else zip_by_key(mean, features, "ts")


def cluster_name(c) -> Column:
    return F.concat(F.lit("Cluster_"), F.col(c).cast("string"))
