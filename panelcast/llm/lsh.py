"""Embedding near duplicates by Euclidean p-stable hashing, checked by exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.graph import components, spanning
from panelcast.llm.sized import small_left_join
from panelcast.llm.streams import groups, matrix, usable, vectors
from panelcast.session import cut_lineage

#: Least chance that a pair at the threshold meets in some table.
RECALL = 0.995
#: Width of a bucket, for vectors of length one.
WIDTH = 2.5
#: Unrelated vectors that meet in a bucket on average.
OCCUPANCY = 64
#: Vectors of a bucket that are compared in one piece; larger buckets are compared in pairs of tiles.
TILE = 2048


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two points at ``distance``."""
    if distance <= 0:
        return 1.0
    x = width / distance
    return 1 - math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan_tables(n: int, threshold: float, recall: float = RECALL, width: float = WIDTH, occupancy: int = OCCUPANCY) -> tuple[int, int]:
    """(projections in a table, tables) for ``n`` vectors: orthogonal ones meet ``occupancy`` to a bucket, near ones with ``recall``."""
    k = max(4, math.ceil(math.log(max(n, 2) / occupancy) / -math.log(collision(math.sqrt(2), width)))) if n > occupancy else 4
    near = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width) ** k
    return k, 1 if near >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - near)))


@cache
def _family(dim: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k), rng.integers(1, 1 << 62, tables * k, dtype=np.int64) | 1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as vectors of length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, k: int, tables: int, width: float = WIDTH, seed: int = 42) -> np.ndarray:
    """One 64-bit bucket key for each row of ``x`` (length one) and table."""
    a, b, mult = _family(x.shape[1], k, tables, width, seed)
    cells = np.floor((x @ a + b) / width).astype(np.int64)
    mixed = (cells * mult).reshape(len(x), tables, k).sum(axis=2)
    mixed = (mixed ^ (mixed >> 29)) * np.int64(0x3F58476D1CE4E5B9) + np.arange(tables, dtype=np.int64) * np.int64(0x1E3779B97F4A7C15)
    return mixed ^ (mixed >> 32)


def links_in(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows (length one) with cosine at the threshold or above."""
    found = [(i + at, j) for at in range(0, len(left), 512) for i, j in [np.nonzero(left[at : at + 512] @ right.T >= threshold - 1e-9)]]
    i, j = (np.concatenate([f[s] for f in found]) for s in (0, 1))
    sure = np.einsum("ij,ij->i", left[i], right[j]) >= threshold if len(i) else np.zeros(0, dtype=bool)
    return i[sure], j[sure]


def near_links(classes: DataFrame, k: int, tables: int, threshold: float, width: float = WIDTH, seed: int = 42, tile: int = TILE) -> DataFrame:
    """(u, v, links): for each class u the members of the classes linked to it (v null), and spanning edges u, v.

    A pair that meets in several tables counts in the first of them only. Buckets beyond ``tile``
    rows are cut into tiles and compared tile by tile, in separate tasks, so no group is unbounded.
    """
    kind = dict(classes.dtypes)["vec"]

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("vec").value_lengths())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                keys = bucket_keys(unit(matrix(part.column("vec"))), k, tables, width, seed)
                for t in range(tables):
                    cols = [pa.array(keys[:, t]), pa.array(np.full(len(keys), t, dtype=np.int32)), part.column("rep"), part.column("n"), part.column("vec")]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "t", "rep", "n", "vec"])

    hashed = classes.select("rep", "n", "vec").mapInArrow(hash_rows, f"key long, t int, rep long, n long, vec {kind}")
    large = hashed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > tile).select(F.col("key").alias("big"), F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    large = cut_lineage(large)
    rows = small_left_join(hashed, large, F.col("key") == F.col("big")).withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("w", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("own", "w").alias("i"), F.greatest("own", "w").alias("j"), "own", "t", "rep", "n", "vec")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "i", "j"]):
            if group.num_rows < 2:
                continue
            sizes = np.asarray(group.column("vec").combine_chunks().value_lengths())
            if sizes.min() != sizes.max():
                group = group.filter(pa.array(sizes == np.bincount(sizes).argmax()))
            first, second, t = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("t")[0].as_py()
            rep, n, own = (group.column(c).to_numpy() for c in ("rep", "n", "own"))
            x = unit(matrix(group.column("vec")))
            left = np.arange(len(x)) if first == second else np.flatnonzero(own == first)
            right = left if first == second else np.flatnonzero(own == second)
            if not len(left) or not len(right):
                continue
            p, q = links_in(x[left], x[right], threshold)
            p, q = left[p], right[q]
            once = p < q if first == second else rep[p] != rep[q]
            p, q = p[once], q[once]
            if t and len(p):
                involved, where = np.unique(np.concatenate([p, q]), return_inverse=True)
                keys = bucket_keys(x[involved], k, tables, width, seed)[:, :t]
                new = np.ones(len(p), dtype=bool)
                for at in range(0, len(p), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    new[s] = ~(keys[where[: len(p)][s]] == keys[where[len(p) :][s]]).any(axis=1)
                p, q = p[new], q[new]
            if not len(p):
                continue
            links = np.bincount(p, n[q], len(x)) + np.bincount(q, n[p], len(x))
            hit = np.flatnonzero(links)
            u, v = zip(*spanning(zip(rep[p].tolist(), rep[q].tolist(), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.nulls(len(hit), pa.int64()), pa.array(links[hit].astype(np.int64))], ["u", "v", "links"])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.zeros(len(u), dtype=np.int64))], ["u", "v", "links"])

    return dealt.mapInArrow(compare, "u long, v long, links long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``df``.

    Equal vectors are one class with a weight, so copies are never paired; every other pair that
    shares a bucket is checked by its cosine in double precision. Rows with unusable vectors have no
    links and are their own component. A repeated row counts as another vector. Vectors of unequal
    length never link. An empty table gives no rows.
    """
    keyed = vectors(df, id_col, vec_col)
    classes = cut_lineage(keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    k, tables = plan_tables(classes.count(), threshold, recall)
    found = cut_lineage(near_links(classes, k, tables, threshold))
    sums = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    comp = components(found.where("v is not null").select("u", "v"))
    info = classes.join(sums, F.col("rep") == F.col("u"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    info = info.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("id", "h1", "h2").join(info, ["h1", "h2"]).select("id", "n_links", "component_id")
    others = df.where(~usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return linked.unionByName(others).withColumn("kept", F.col("id") == F.col("component_id"))

