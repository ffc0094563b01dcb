"""Silhouette under Euclidean distance, exact for any number of entities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

#: Entities in a tile.
TILE = 1024
#: Differences held at a time in a pair of tiles.
STEP = 1 << 21


def _rows(cell: pa.Array, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(labels, vectors) of one tile."""
    flat = cell.flatten() if isinstance(cell, pa.ListArray) else cell
    return np.asarray(flat.field("lab")), np.asarray(flat.field("vec").flatten(), dtype=float).reshape(len(flat), p)


def _sums(a: np.ndarray, b: np.ndarray, hot_a: np.ndarray, hot_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances from each row of a to the clusters of b, and from each row of b to those of a."""
    left, right = np.zeros((len(a), hot_b.shape[1])), np.zeros((len(b), hot_a.shape[1]))
    step = max(1, STEP // max(1, b.size))
    for at in range(0, len(a), step):
        d = np.sqrt(((a[at : at + step, None, :] - b[None]) ** 2).sum(axis=2))
        left[at : at + step] = d @ hot_b
        right += d.T @ hot_a[at : at + step]
    return left, right


def silhouette_euclidean(df: DataFrame, cols: Sequence[str], labels: str = "cluster", key: str = "entity", tile: int = TILE) -> DataFrame:
    """``(key, labels, silhouette)``: (b - a) / max(a, b) with the mean Euclidean distances to the own and the nearest other cluster.

    Entities are dealt to tiles of bounded size by a hash. Every pair of tiles meets once, in a
    task that holds both; what leaves it is one sum for each entity and cluster, so no pair of entities is ever a row. All n^2
    distances are computed, which this measure needs; ``cluster.silhouette`` has the squared distance without them.
    0 for a cluster of one, null where there is one cluster only. Rows without label or with gaps take no part; equal keys are entities of their own.
    """
    cols, p = list(cols), len(cols)
    whole = df.select(F.col(key).alias("_key"), F.col(labels).alias("_lab"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))
    whole = whole.where(F.col("_lab").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    names = sorted(r[0] for r in whole.select("_lab").distinct().collect())  # one row a cluster
    lab = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_lab")).cast("int") - 1 if names else F.lit(0)
    tiles = max(1, -(-whole.count() // tile))
    member = F.struct(F.col("_key").alias("k"), lab.alias("lab"), "vec")
    dealt = cut_lineage(whole.groupBy(F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(tiles)).cast("int").alias("t")).agg(F.array_sort(F.collect_list(member)).alias("m")))
    left = dealt.select("t", F.transform("m", lambda x: F.struct(x["lab"].alias("lab"), x["vec"].alias("vec"))).alias("m"), F.explode(F.sequence("t", F.lit(tiles - 1))).alias("u"))
    right = dealt.select(F.col("t").alias("u"), F.transform("m", lambda x: F.struct(x["lab"].alias("lab"), x["vec"].alias("vec"))).alias("n"))
    count = len(names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, u = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                (la, a), (lb, b) = (_rows(batch.column(c)[i].values, p) for c in (2, 3))
                own, other = _sums(a, b, np.eye(count)[la], np.eye(count)[lb])
                out = [(t, own)] if t == u else [(t, own), (u, other)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([m.tobytes() for _, m in out], pa.binary())], ["t", "sums"])

    parts = left.join(right, "u").select("t", "u", "m", "n").mapInArrow(meet, "t int, sums binary")
    sized = dealt.select(F.explode("m.lab").alias("lab")).groupBy("lab").agg(F.count("*").alias("n"))
    n = np.zeros(count)
    for r in sized.collect():
        n[r["lab"]] = r["n"]
    key_type, lab_type = df.schema[key].dataType.simpleString(), df.schema[labels].dataType.simpleString()
    kept = dealt.select("t", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("sums"), F.col("m.lab").alias("lab"))
    stream = parts.select("t", F.lit(0).alias("kind"), "sums", F.lit(None).cast("array<int>").alias("lab")).unionByName(kept)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for t, kind, sums, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != now:
                    now, total = t, None
                if kind == 0:
                    part = np.frombuffer(sums, dtype=float).reshape(-1, count)
                    total = part if total is None else total + part
                    continue
                own, at = np.array(own), np.arange(len(own))
                others = np.where(np.arange(count)[None, :] == own[:, None], np.inf, total / n)
                b = others.min(axis=1)
                a = total[at, own] / np.maximum(n[own] - 1, 1)
                top = np.maximum(a, b)
                s = np.where(n[own] == 1, 0.0, np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0))
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(own), pa.int32()), pa.array(at, pa.int32()), pa.array(np.where(np.isinf(b), np.nan, s), from_pandas=True)], ["t", "pos", "silhouette"])

    scored = stream.repartition("t").sortWithinPartitions("t", "kind").mapInArrow(finish, "t int, pos int, silhouette double")
    named = dealt.select("t", F.posexplode("m").alias("pos", "x"))
    label = F.get(F.array(*[F.lit(v) for v in names]), F.col("x.lab")) if names else F.lit(None)
    return named.join(scored, ["t", "pos"]).select(F.col("x.k").cast(key_type).alias(key), label.cast(lab_type).alias(labels), "silhouette")
