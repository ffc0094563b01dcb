"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square test holds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.streams import groups, listed, matrix, vectors
from panelcast.session import cut_lineage

#: Projected dimensions (even, for the closed form of the chi-square distribution).
PROJECTED = 8
#: Chance with which a true neighbour at the distance of the last one found is inside the searched radius.
CONFIDENCE = 0.99
#: Rows a cell aims at, rows in a pack, rows in a leaf, queries in a block.
CELL, PACK, LEAF, BLOCK = 4096, 2048, 64, 512
#: Rows the kd-tree over cells is fitted on at most, and sample rows a cell needs.
SAMPLE, PER_CELL = 50_000, 25


def chi_square(quantile: float, freedom: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        tail, term = 0.0, math.exp(-x / 2)
        for i in range(freedom // 2):
            tail += term
            term *= x / 2 / (i + 1)
        low, high = (x, high) if 1 - tail < quantile else (low, x)
    return high


class KdTree:
    """Median splits along the widest direction; leaves are numbered from the left."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        self.root = self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        if leaves < 2 or len(points) < 2 or not (spread := np.ptp(points, axis=0)).max() > 0:
            self.leaves += 1
            return -self.leaves
        axis = int(spread.argmax())
        share = leaves // 2
        cut = float(np.partition(points[:, axis], len(points) * share // leaves)[len(points) * share // leaves])
        if not (points[:, axis] < cut).any():
            cut = float(points[:, axis][points[:, axis] > cut].min())
        node = len(self.axis)
        for store, x in ((self.axis, axis), (self.cut, cut), (self.left, 0), (self.right, 0)):
            store.append(x)
        low = points[:, axis] < cut
        self.left[node] = self._split(points[low], share)
        self.right[node] = self._split(points[~low], leaves - share)
        return node

    def leaf(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point."""
        at = np.full(len(points), self.root)
        if self.axis:
            axis, cut, left, right = (np.array(x) for x in (self.axis, self.cut, self.left, self.right))
            while (open_ := np.flatnonzero(at >= 0)).size:
                node = at[open_]
                at[open_] = np.where(points[open_, axis[node]] < cut[node], left[node], right[node])
        return -at - 1


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    return out


class Projection:
    """Gaussian (2-stable) projections of vectors lifted so that the largest inner product is the least distance."""

    def __init__(self, dim: int, most: float, projected: int, seed: int) -> None:
        self.most = most
        self.a = np.random.default_rng([seed, dim]).standard_normal((dim + 1, projected))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        lift = np.sqrt(np.maximum(0.0, self.most - (x * x).sum(axis=1)))
        return x @ self.a[:-1] + lift[:, None] * self.a[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q.astype(np.float64) @ self.a[:-1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def nearest(
    candidates: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 20,
    projected: int = PROJECTED,
    confidence: float = CONFIDENCE,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` candidates with the largest inner product found for each query.

    A query never finds its own id; ties go to the smaller id. Vectors that are null, empty or zero,
    hold nulls or non-finite numbers, or have another length than most candidates take no part.
    Repeated rows count once. Of equal vectors only the ``k + 1`` least ids can be among the nearest;
    they are taken out before the index is built, so copies make no group large. An empty table on
    either side gives no rows.

    Vectors lie in cells of a kd-tree over their projections (fitted on at most SAMPLE rows, every row
    is indexed). A query first verifies its home cell; the distance of its k-th neighbour d then
    bounds the search: incremental neighbours are verified leaf by leaf as long as the projected
    distance is at most d * sqrt(chi-square quantile), as beyond it a nearer neighbour is unlikely.
    """
    spark = candidates.sparkSession
    rows = vectors(candidates, id_col, vec_col)
    asked = vectors(queries, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]
    kind = dict(rows.dtypes)["vec"]
    rows, asked = rows.where(F.size("vec") == dim), asked.where(F.size("vec") == dim).dropDuplicates(["id"])

    by_copy = Window.partitionBy("h1", "h2", F.pmod("id", F.lit(64))).orderBy("id")
    first = rows.withColumn("seen", F.lag("id").over(by_copy)).where("seen is null or seen <> id").withColumn("nth", F.row_number().over(by_copy)).where(F.col("nth") <= k + 1)
    by_class = Window.partitionBy("h1", "h2").orderBy("id")
    rows = cut_lineage(first.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= k + 1).select("id", "vec"))

    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, most = rows.agg(F.count("*"), F.max(square)).first()
    project = Projection(dim, most, projected, seed)
    step = -(-total // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy(F.xxhash64("id")).limit(SAMPLE).select("vec").toArrow()
    cells = max(1, min(-(-total // CELL), sample.num_rows // PER_CELL))
    tree = KdTree(project.rows(matrix(sample.column(0))), cells) if sample.num_rows else KdTree(np.zeros((0, projected)), 1)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = tree.leaf(project.rows(matrix(batch.column("vec"))))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("id"), batch.column("vec")], ["cell", "id", "vec"])

    placed = rows.mapInArrow(to_cells, f"cell long, id long, vec {kind}")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    slots = spark.createDataFrame([(i, max(1, -(-int(n) // PACK))) for i, n in enumerate(counts)], "cell long, slots int")
    dealt = placed.join(F.broadcast(slots), "cell").withColumn("slot", F.pmod(F.xxhash64("id"), "slots")).repartition("cell", "slot").sortWithinPartitions("cell", "slot")

    def to_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cell", "slot"]):
            x = matrix(group.column("vec"))
            p = project.rows(x)
            leaf = KdTree(p, -(-len(p) // LEAF)).leaf(p)
            order = np.argsort(leaf, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(leaf[order]) > 0])
            p = p[order]
            low, high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
            out = [group.column("cell")[0].as_py(), *(a.tobytes() for a in (group.column("id").to_numpy()[order], x[order], starts, low, high))]
            yield pa.RecordBatch.from_pylist([dict(zip(["cell", "ids", "vecs", "starts", "low", "high"], out, strict=True))])

    packs = cut_lineage(dealt.mapInArrow(to_packs, "cell long, ids binary, vecs binary, starts binary, low binary, high binary"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, low, high in zip(batch.column("cell").to_pylist(), batch.column("low"), batch.column("high"), strict=True):
                a, b = (np.frombuffer(v.as_py()).reshape(-1, projected) for v in (low, high))
                yield pa.RecordBatch.from_arrays([pa.array([cell] * projected), pa.array(range(projected)), pa.array(a.min(axis=0)), pa.array(b.max(axis=0))], ["cell", "d", "low", "high"])

    low, high = np.full((tree.leaves, projected), np.inf), np.full((tree.leaves, projected), -np.inf)
    for r in packs.select("cell", "low", "high").mapInArrow(boxes, "cell long, d long, low double, high double").groupBy("cell", "d").agg(F.min("low"), F.max("high")).collect():
        low[r[0], r[1]], high[r[0], r[1]] = r[2], r[3]
    there = np.flatnonzero(np.isfinite(low[:, 0]))
    radius = chi_square(confidence, projected)
    dtype = np.float32 if kind == "array<float>" else np.float64

    def search(blocks: DataFrame) -> DataFrame:
        """(query_id, id, score) of up to k or more verified candidates for each row (cell, query_id, vec, least score) and pack of its cell."""
        blocks = blocks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked_n // BLOCK)))))
        packed = blocks.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "vec", "least")).alias("qs")).select("cell", "qs.query_id", "qs.vec", "qs.least")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {n: batch.column(n)[r] for n in batch.schema.names}
                    names, least = (np.asarray(row[c].values) for c in ("query_id", "least"))
                    q = np.asarray(row["vec"].values.flatten()).reshape(len(names), dim)
                    ids, starts = (np.frombuffer(row[c].as_py(), dtype=np.int64) for c in ("ids", "starts"))
                    x = np.frombuffer(row["vecs"].as_py(), dtype=dtype).reshape(-1, dim)
                    boxes_ = [np.frombuffer(row[c].as_py()).reshape(-1, projected) for c in ("low", "high")]
                    q64, x64 = q.astype(np.float64), x.astype(np.float64)
                    far = gaps(project.queries(q), *boxes_)
                    reach = np.maximum(0.0, (q64 * q64).sum(axis=1) + most - 2 * least) * radius
                    score = np.full((len(q), len(x)), -np.inf)
                    ends = np.append(starts[1:], len(x))
                    for leaf in range(len(starts)):
                        ask = np.flatnonzero(far[:, leaf] <= reach)
                        if len(ask):
                            score[ask, starts[leaf] : ends[leaf]] = q64[ask] @ x64[starts[leaf] : ends[leaf]].T
                    score[names[:, None] == ids[None, :]] = -np.inf
                    floor = np.partition(score, -k, axis=1)[:, -k] if len(x) > k else np.full(len(q), -np.inf)
                    floor = np.maximum(floor, least)
                    i, j = np.nonzero((score >= (floor - 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None]) & (score > -np.inf))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[j]), pa.array(products(q[i], x[j]))], ["query_id", "id", "score"])

        return packed.join(packs, "cell").mapInArrow(run, "query_id long, id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = there[gaps(project.queries(matrix(batch.column("vec"))), low[there], high[there]).argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column("id"), batch.column("vec")], ["cell", "query_id", "vec"])

    asked_n = asked.count()
    start = cut_lineage(asked.select("id", "vec").mapInArrow(home, f"cell long, query_id long, vec {kind}"))
    near = cut_lineage(best(search(start.withColumn("least", F.lit(float("-inf"))))))
    kth = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = matrix(batch.column("vec"))
            least = batch.column("least").to_numpy(zero_copy_only=False)
            reach = np.maximum(0.0, (q.astype(np.float64) ** 2).sum(axis=1) + most - 2 * least) * radius
            open_ = (gaps(project.queries(q), low[there], high[there]) <= reach[:, None]) & (there[None, :] != batch.column("cell").to_numpy()[:, None])
            i, j = np.nonzero(open_)
            yield pa.RecordBatch.from_arrays([pa.array(there[j].astype(np.int64)), batch.column("query_id").take(pa.array(i)), listed(q[i]), pa.array(least[i])], ["cell", "query_id", "vec", "least"])

    rest = start.join(kth, "query_id", "left").select("cell", "query_id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    more = search(rest.mapInArrow(onward, f"cell long, query_id long, vec {kind}, least double"))
    return best(near.select("query_id", "id", "score").unionByName(more)).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
