"""Token pieces of documents, and best-fit packing by exact-complement hashing."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

CAPACITY = 4096
#: The id after each document.
END = 1
#: Words a task remembers.
REMEMBERED = 400_000

#: Texts of these characters only are split here; all others go to the tokenizer whole.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The vocabulary's own pattern over lower-cased plain text.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\s0-9a-zà-öø-ÿß]+")


class Words(dict):
    """Ids of the words met so far, as bytes; a word not met yet is merged by the vocabulary's model alone.

    Words are lower-case pre-tokens already, so normalising and splitting them again would give the same.
    """

    def __init__(self, tokenizer) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.model, self.spell = tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.model.tokenize(word if word.isascii() else self.spell(word)[0][0])
        ids = self[word] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        return ids


class WordTokens:
    """Ids of texts under a lower-casing word-level BPE file; words once encoded are remembered."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known = Words(self.tokenizer)

    def encode(self, text: str) -> np.ndarray:
        if not PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, WORDS.findall(text.lower()))), dtype="<u4")


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = True
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids): the tokens of each document and ``end``, cut only where longer than ``capacity``.

    A null or empty text is the one id ``end``. Without ``with_ids`` the ids stay in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            parts: list[np.ndarray] = []
            for name, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.encode(cell.as_py() or ""), np.uint32(end)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((name, k, at, len(part), zlib.crc32(part)))
                    if with_ids:
                        parts.append(part)
            if rows:
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(np.cumsum([0, *cols[3]]).astype(np.int32), pa.array(np.concatenate(parts).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])
        encoder.known.clear()  # a worker that goes on to other tasks doesn't keep it

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths in a bin, number of such bins) for ``counts`` pieces of each length.

    Works on the counts of at most ``capacity`` lengths, so its cost does not depend on the number of
    pieces. From the longest length down, the gap it leaves is filled exactly by one, two or three
    lengths whose sum is the gap, as often as the counts allow; what finds no exact complement goes,
    longest first, into the open bin with the least room that holds it.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> bool:
        """Uses the combination as often as it is there."""
        times = min(int(have[x]) // lengths.count(x) for x in set(lengths))
        if times:
            for x in lengths:
                have[x] -= times
            bins.append((lengths, times))
        return times > 0

    def pair_of(total: int) -> Iterator[tuple[int, int]]:
        """Lengths (x, y), x >= y, with that sum, both there, the longest x first."""
        low = have[1 : total // 2 + 1]
        high = have[total - 1 : total - len(low) - 1 : -1] if len(low) else low
        for i in np.flatnonzero((low > 0) & (high > 0)).tolist():
            yield total - 1 - i, i + 1

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if have[length] and not gap:
            take(length)
        if have[length] and gap and gap <= length:
            take(length, gap)
        if have[length]:
            for x, y in pair_of(gap):
                if x <= length and take(length, x, y) and not have[length]:
                    break
        if have[length]:
            for x in np.flatnonzero(have[: min(length, gap) + 1])[::-1].tolist():
                if not have[length]:
                    break
                for y, z in pair_of(gap - x):
                    if y <= x and take(length, x, y, z) and not (have[length] and have[x]):
                        break

    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            open_bins.setdefault(room, []).append((lengths, times))
            rooms[room] = True

    for length in np.flatnonzero(have)[::-1].tolist():
        n = int(have[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                per = capacity // length
                put(capacity - per * length, (length,) * per, n // per)
                rest = n % per
                put(capacity - rest * length, (length,) * rest, 1 if rest else 0)
                break
            room = length + int(fits[0])
            lengths, times = open_bins[room].pop()
            rooms[room] = bool(open_bins[room])
            used = min(n, times)
            put(room, lengths, times - used)
            put(room - length, (*lengths, length), used)
            n -= used
    return bins + [b for group in open_bins.values() for b in group]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (id, piece, start, length, ids_crc32 ...) with sequence_id and offset.

    Only the counts by length reach the driver. Each piece gets its rank among the pieces of its
    length, numbered in salted groups, so that a length which most pieces share is spread; the rank
    then tells its bin. The plan of bins has a bound that depends on ``capacity`` alone.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spans: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    first = 0
    for lengths, times in fill(counts, capacity):
        offset = 0
        for length in lengths:
            spans.append((length, used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        first += times
    plan = np.array(sorted(spans), dtype=np.int64).reshape(-1, 4)
    keys = (plan[:, 0] << 44) | plan[:, 1]

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("nth"))
    cols = [c for c in parts.columns]
    ranked = ranked.select(*cols, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) | rank, side="right") - 1
            out = [batch.column(c) for c in cols] + [pa.array(plan[at, 2] + rank - plan[at, 1]), pa.array(plan[at, 3])]
            yield pa.RecordBatch.from_arrays(out, [*cols, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of every document, with its place in a sequence. An empty table gives no rows."""
    parts = pieces(docs, tokenizer, id_col, text_col, capacity, with_ids=False)
    return pack(cut_lineage(parts), capacity).withColumnRenamed("id", "doc_id")
