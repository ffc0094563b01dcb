"""SimHash near duplicates by tiled exact comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.graph import components, spanning
from panelcast.llm.hot import hot_join
from panelcast.llm.sized import BROADCAST_CELLS
from panelcast.llm.streams import listed, matrix
from panelcast.session import cut_lineage

#: Fingerprints in a tile; two tiles of this size fit any task.
TILE = 8192
#: Shingles whose bits are unpacked at a time.
STEP = 1 << 15
#: Numbers in the fingerprint of ``keep_one``, differing bits up to which a pair is looked at, in the first number and in all of them.
SIZE, FIRST, LOOKED = 4, 24, 76
#: Words of a shingle in ``keep_one``, and the similarity from which texts are near duplicates.
WORDS, SIMILAR = 5, 0.8
#: Bytes of shingle sets in a block of a family; two blocks of this size fit any task.
FAMILY = 4 << 20


def shingles(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles of a text, STEP at a time; a text of fewer words is one shingle, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    words = min(words, len(found))
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
    n = len(found) - words + 1
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[words - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        yield np.array([digest(line[s:e], seed) for s, e in zip(starts[at : at + STEP].tolist(), stops[at : at + STEP].tolist(), strict=True)], dtype="<u8")


def shingle_set(text: str | None, words: int = WORDS, seed: int = 42) -> np.ndarray:
    """The distinct hashes of ``shingles`` in order."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *shingles(text, words, seed)]))


def fingerprint(text: str | None, words: int = 3, seed: int = 42, size: int = 1, once: bool = False) -> tuple[np.ndarray, int]:
    """(SimHash of the word shingles of a whole text as ``size`` unsigned 64-bit numbers, zero for a text without words; shingles counted).

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space
    and hashed by XXH64; a bit is set if more than half of the shingles set it: repeats included, or
    each counted ``once``. Numbers beyond the first take their bits from a mix of the same hash.
    """
    n, counts = 0, np.zeros((size, 64), dtype=np.int64)
    whole = shingle_set(text, words, seed) if once else None
    for hashes in shingles(text, words, seed) if whole is None else (whole[at : at + STEP] for at in range(0, len(whole), STEP)):
        n += len(hashes)
        for k in range(size):
            counts[k] += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            if k + 1 < size:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                hashes ^= hashes >> np.uint64(32)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8").ravel(), n


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, size: int = 1, once: bool = False) -> DataFrame:
    """(id, fp, more, n, h): signed 64-bit numbers of the fingerprint of each row, the first one apart, the number of shingles counted, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [fingerprint(t.as_py(), words, seed, size, once) for t in batch.column(1)]
                fps = np.stack([f for f, _ in found]).view(np.int64)
                n = pa.array([n for _, n in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps[:, 0].copy()), listed(fps[:, 1:]), n, batch.column(2)], ["id", "fp", "more", "n", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "id long, fp long, more array<long>, n long, h long")


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, total: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two fingerprint arrays (rows of 64-bit numbers) that differ in at most ``radius`` bits of the first number and ``total`` of all."""
    step = max(1, (1 << 17) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, 0, None] ^ right[None, :, 0]) <= radius)
        i += at
        if left.shape[1] > 1 and len(i):
            near = np.bitwise_count(left[i] ^ right[j]).sum(axis=1) <= total
            i, j = i[near], j[near]
        if len(i):
            yield i, j


def forest(ids: np.ndarray, ids2: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges (larger, smaller id) with the components of the index pairs; pairs inside a component found before cost no step of their own."""
    names, where = np.unique(np.concatenate([ids, ids2]), return_inverse=True)
    own, other = where[: len(ids)], where[len(ids) :]
    label = np.arange(len(names))
    for i, j in pairs:
        a, b = label[own[i]], label[other[j]]
        if (new := a != b).any():
            for high, low in spanning(map(tuple, np.unique(np.column_stack([a[new], b[new]]), axis=0).tolist())):
                label[label == high] = low
    return [(int(names[k]), int(names[label[k]])) for k in np.flatnonzero(label != np.arange(len(names)))]


def linking(ids: np.ndarray, ids2: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Those of the pairs, as ids, that join what the pairs before left apart."""
    names, where = np.unique(np.concatenate([ids, ids2]), return_inverse=True)
    own, other = where[: len(ids)], where[len(ids) :]
    label = np.arange(len(names))
    for i, j in pairs:
        a, b = label[own[i]], label[other[j]]
        if not (new := a != b).any():
            continue
        i, j, root = i[new], j[new], {}

        def top(x: int, root: dict[int, int] = root) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        ends, first = np.unique(np.column_stack([a[new], b[new]]), axis=0, return_index=True)
        for (x, y), k in zip(ends.tolist(), first.tolist(), strict=True):
            if (x := top(x)) != (y := top(y)):
                root[max(x, y)] = min(x, y)
                yield int(ids[i[k]]), int(ids2[j[k]])
        changed = np.arange(len(names))
        for x in root:
            changed[x] = top(x)
        label = changed[label]


def tile_units(distinct: DataFrame, radius: int, tile: int = TILE, sized: bool = False) -> DataFrame:
    """(ids, fps, ids2, fps2): pairs of tiles that may hold near rows of ``distinct`` (id, fp, more: each fingerprint once).

    Fingerprints are laid out in tiles by the population counts of the two halves of ``fp``, in ranges that widen
    with the radius. The sum of the two count differences never exceeds the number of differing bits,
    so tile pairs beyond the radius are skipped; every other pair of tiles is compared exactly. The
    table of counts has at most 33 x 33 rows, whatever the input. ``sized`` rows also have ``n``, their number of distinct
    shingles: sets of similarity SIMILAR differ in size by less than its inverse, so only tiles of the same and the next size meet.
    """
    spark = distinct.sparkSession
    wide = max(1, radius // 2)
    low, high = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("fp", 32))
    size = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1 / SIMILAR)) + 1e-9).cast("int") if sized else F.lit(0)
    cell = ["a", "b", "z"]
    rows = distinct.select("id", "fp", "more", F.floor(high / wide).cast("int").alias("a"), F.floor(low / wide).cast("int").alias("b"), size.alias("z"))
    counts = {(r["a"], r["b"], r["z"]): -(-r["n"] // tile) for r in rows.groupBy(*cell).agg(F.count("*").alias("n")).collect()}
    gap = lambda x, y: max(0, (abs(x - y) - 1) * wide + 1)
    plan = [(*x, *y, counts[y]) for x in counts for y in counts if x <= y and abs(x[2] - y[2]) <= 1 and gap(x[0], y[0]) + gap(x[1], y[1]) <= radius]
    tiles = spark.createDataFrame([(*x, n) for x, n in counts.items()], "a int, b int, z int, n long")
    packed = (
        rows.join(F.broadcast(tiles), cell)
        .groupBy(*cell, F.pmod(F.xxhash64("fp"), "n").alias("t"))
        .agg(F.collect_list("id").alias("ids"), F.collect_list(F.concat(F.array("fp"), "more")).alias("fps"))
    )
    partners = spark.createDataFrame(plan, "a int, b int, z int, c int, d int, y int, n long")
    left = (
        packed.join(F.broadcast(partners), cell)
        .select(*cell, "t", "c", "d", "y", "ids", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("w"))
        .where("(a, b, z) <> (c, d, y) or t <= w")
    )
    right = packed.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("z").alias("y"), F.col("t").alias("w"), F.col("ids").alias("ids2"), F.col("fps").alias("fps2"))
    return left.join(right, ["c", "d", "y", "w"]).select("ids", "fps", "ids2", "fps2")


def near_edges(distinct: DataFrame, radius: int = 2, total: int = 2, tile: int = TILE) -> DataFrame:
    """Spanning edges (u, v) between near rows of ``distinct``: those that differ in at most ``radius`` bits of ``fp`` and ``total`` bits altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ids2 = (np.asarray(batch.column(c)[k].values) for c in (0, 2))
                fps, fps2 = (matrix(batch.column(c)[k].values).view(np.uint64) for c in (1, 3))
                if edges := forest(ids, ids2, close_pairs(fps, fps2, radius, total)):
                    u, v = zip(*edges, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tile_units(distinct, radius, tile).mapInArrow(run, "u long, v long")


def near_pairs(distinct: DataFrame, radius: int, total: int, tile: int = TILE, sized: bool = False) -> DataFrame:
    """(u, v): as many near rows of ``distinct`` as connect what is near, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, ids2 = (np.asarray(batch.column(c)[k].values) for c in (0, 2))
                fps, fps2 = (matrix(batch.column(c)[k].values).view(np.uint64) for c in (1, 3))
                if pairs := list(linking(ids, ids2, close_pairs(fps, fps2, radius, total))):
                    u, v = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    found = tile_units(distinct, radius, tile, sized).mapInArrow(run, "u long, v long").where("u <> v")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, shingles): a hash of each text, and the distinct hashes of its five-word shingles in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingle_set(t.as_py()).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), sets], ["id", "h", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "id long, h long, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILAR (four fifths) or more."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return 5 * common >= 4 * (len(a) + len(b) - common)


def verified(ids: np.ndarray, ids2: np.ndarray, sets: list[np.ndarray], sets2: list[np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges (larger, smaller id) with the components of those of the index pairs whose sets are alike; a pair inside a component found before isn't looked at."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for i, j in pairs:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = int(ids[a]), int(ids2[b])
            if (x := top(x)) != (y := top(y)) and alike(sets[a], sets2[b]):
                root[max(x, y)] = min(x, y)
                out.append((max(x, y), min(x, y)))
    return out


def alike_edges(members: DataFrame, radius: int, total: int, size: int = FAMILY) -> DataFrame:
    """Spanning edges (u, v) between the alike rows of each family of ``members`` (family, id, fp, more, shingles).

    A family is dealt to blocks of about ``size`` bytes, and each pair of its blocks meets in a task that reads off the
    fingerprints which rows to compare and compares their sets. Only linking edges leave a task, so
    a large family of texts that are near by their bits but not alike costs time and no rows.
    """
    bytes_ = F.length("shingles") + 64
    sizes = cut_lineage(members.groupBy("family").agg(F.ceil(F.sum(bytes_) / F.lit(size)).alias("blocks"), F.count("*").alias("rows")))
    total_rows = sizes.agg(F.sum("rows").alias("n")).first()["n"] or 0
    dealt = hot_join(members, sizes, "family", "rows", total_rows).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    row = F.struct("id", F.concat(F.array("fp"), "more").alias("fps"), "shingles")
    packed = cut_lineage(dealt.groupBy("family", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(row).alias("m")))
    left = packed.select("family", "block", "m", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    alone = left.where("block = other").select("m", F.lit(None).cast(packed.schema["m"].dataType).alias("m2"))
    both = left.where("block < other").join(packed.select("family", F.col("block").alias("other"), F.col("m").alias("m2")), ["family", "other"]).select("m", "m2")

    def parts(cell: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        rows = cell.values
        return np.asarray(rows.field("id")), matrix(rows.field("fps")).view(np.uint64), [np.frombuffer(x, dtype="<u8") for x in rows.field("shingles").to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                ids, fps, sets = parts(batch.column(0)[k])
                ids2, fps2, sets2 = parts(batch.column(1)[k]) if batch.column(1)[k].is_valid else (ids, fps, sets)
                out += verified(ids, ids2, sets, sets2, close_pairs(fps, fps2, radius, total))
            if out:
                u, v = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return alone.union(both).mapInArrow(run, "u long, v long")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2, size: int = 1, total: int | None = None
) -> DataFrame:
    """(id, fp, component): components of documents with near fingerprints of ``size`` 64-bit numbers.

    Near means at most ``radius`` differing bits in the first number and ``total`` in all. Equal
    fingerprints are one node, so copies are never paired. Null and empty texts have the fingerprint
    zero and link like any other. Repeated ids give repeated rows; an empty table gives no rows.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, words, seed, size))
    distinct = cut_lineage(fps.groupBy("fp", "more").agg(F.min("id").alias("id")))
    comp = components(near_edges(distinct, radius, radius if total is None else total))
    named = distinct.join(comp, distinct["id"] == comp["node"], "left").select("fp", "more", F.coalesce("component", "id").alias("component"))
    return fps.join(named, ["fp", "more"]).select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but the least id of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Fingerprints only choose what is looked at; the sets of shingles of the whole texts decide. The
    share of bits in which two fingerprints differ estimates the angle between the shingle sets. At a
    similarity of 0.8 it is 0.15 on average, so of 256 bits 39 (deviation 6), and 0.19 for texts of
    four and five shingles, 48 bits (deviation 6); LOOKED is 4.5 deviations above, and unrelated texts
    differ in 128 (deviation 8). Tiles of fingerprints, by their bit counts and the number of shingles, give the families
    of texts that such pairs connect; inside a family all pairs near by their bits are decided by their sets, but those
    that are connected already. Rows that share an id are one document and go or stay together; rows with a null id stay.
    """
    named = docs.where(F.col(id_col).isNotNull())
    fps = cut_lineage(fingerprints(named, id_col, text_col, WORDS, size=SIZE, once=True))
    distinct = cut_lineage(fps.groupBy("fp", "more").agg(F.min(F.struct("id", "h")).alias("first"), F.max("n").alias("n")))
    distinct = distinct.select("fp", "more", "n", "first.id", "first.h")
    tried = near_pairs(distinct, FIRST, LOOKED, sized=True)
    family = components(tried).select(F.col("node").alias("id"), F.col("component").alias("family"))
    family = cut_lineage(family)
    few = family.count() <= BROADCAST_CELLS
    here = F.broadcast(family) if few else family.hint("merge")
    texts = named.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")).join(here, "id")
    wanted = distinct.select("id", "h", "fp", "more").join(here, "id")
    # rows that are equal in id and text have one set
    members = cut_lineage(wanted.hint("merge").join(sets_of(texts, "id", "_text").hint("merge"), ["id", "h"]).groupBy("family", "id", "fp", "more").agg(F.first("shingles").alias("shingles")))
    comp = components(alike_edges(members, FIRST, LOOKED))
    group = distinct.join(comp, distinct["id"] == comp["node"], "left").select("fp", "more", F.coalesce("component", "id").alias("component"))
    groups = fps.join(group, ["fp", "more"]).select("id", "component")
    gone = cut_lineage(groups.where("id <> component").select(F.col("id").alias("_gone")).distinct())
    few = gone.count() <= BROADCAST_CELLS
    return docs.join(F.broadcast(gone) if few else gone.hint("merge"), docs[id_col] == gone["_gone"], "left_anti")
