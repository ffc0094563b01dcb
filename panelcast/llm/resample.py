"""Importance resampling towards a target distribution of hashed word n-grams, by segment deduplication."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.crc import crc32s, shifted
from panelcast.llm.hot import hot_join
from panelcast.operators.ordering import ranged_totals
from panelcast.session import cut_lineage, scratch_path

#: Numbers of words in a feature: 1 to this.
GRAM = 3
#: Bytes of text whose words are held as arrays at a time.
BLOCK = 1 << 22
NEWLINE = 0x0A
#: A byte of a word.
WORDY = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """By byte: lower-cased A-Z, and whether it belongs to a word (digits, letters, all bytes beyond ASCII)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


LOWER, WORD = _classes()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = WORD[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, grams: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the runs of 1 to GRAM words that end at each word; ``last`` names the words, ``grams`` (words, GRAM) tells which runs are wanted.

    Row after row, so in the order of the words. Only words of a wanted run are hashed.
    """
    reach = np.zeros(len(starts), dtype=bool)
    for k in range(GRAM):
        at = last[grams[:, k]]
        for back in range(k + 1):
            reach[at - back] = True
    own = np.zeros(len(starts), dtype=np.uint32)
    used = np.flatnonzero(reach)
    own[used] = crc32s(data, starts[used], ends[used])
    size = ends - starts
    space = np.array([0xE96CCF45], dtype=np.uint32)  # CRC-32 of one space
    spaced = shifted(np.broadcast_to(space, len(starts)), size) ^ own
    out = np.zeros(grams.shape, dtype=np.uint32)
    for k in range(GRAM):
        at = last[grams[:, k]]
        crc = own[at - k]
        for back in range(k - 1, -1, -1):
            crc = shifted(crc, size[at - back] + 1) ^ spaced[at - back]
        out[grams[:, k], k] = crc
    return (out % np.uint32(buckets)).astype(np.uint16)[grams]


def _cut(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """One long text in parts that end behind a word; each begins with the GRAM - 1 words before it, as far as there are any, and says how many."""
    at, back, carried = 0, 0, 0
    while at < len(data):
        stop = min(len(data), at + size)
        while stop < len(data) and WORD[data[stop]]:
            rest = np.flatnonzero(~WORD[data[stop : stop + size]])
            stop = stop + int(rest[0]) if len(rest) else min(len(data), stop + size)
        yield data[back:stop], carried
        starts, _ = words(data[back:stop])
        carried = min(GRAM - 1, len(starts))
        back = back + int(starts[-carried]) if carried else stop
        at = stop


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, rows, bytes, row ends, carried): lower-cased texts of a string column, at most about ``size`` bytes at a time.

    A longer text comes alone, in parts; the first ``carried`` words of a part are the last of the one before.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        raw = LOWER[data[offsets[row] : offsets[stop]]]
        if stop == row + 1 and len(raw) > size:
            for part, carried in _cut(raw, size):
                yield row, 1, part, np.array([len(part)]), carried
        else:
            yield row, stop - row, raw, offsets[row + 1 : stop + 1] - offsets[row], 0
        row = stop


def _wanted(row: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For the words from ``first`` on: their indices, and which runs that end at them lie in one row."""
    last = np.arange(first, len(row))
    grams = np.zeros((len(last), GRAM), dtype=bool)
    for k in range(GRAM):
        ok = last >= k
        grams[ok, k] = row[last[ok]] == row[last[ok] - k]
    return last, grams


def line_features(column: pa.Array, buckets: int, size: int = BLOCK) -> list[np.ndarray]:
    """Buckets of all features of each line of a column."""
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for first, n, data, ends, carried in blocks(column, size):
        starts, stops = words(data)
        row = np.searchsorted(ends, starts, side="right")
        last, grams = _wanted(row, carried)
        found = features(data, starts, stops, last, grams, buckets)
        per = np.bincount(row[last], weights=grams.sum(axis=1), minlength=n).astype(np.int64)
        for k, part in enumerate(np.split(found, np.cumsum(per)[:-1])):
            out[first + k].append(part)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint16), *x]) for x in out]


def cross_features(column: pa.Array, buckets: int, size: int = BLOCK) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text, and the buckets of its features that reach over a newline."""
    counts, out = np.zeros(len(column), dtype=np.int64), [[] for _ in range(len(column))]
    for first, n, data, ends, carried in blocks(column, size):
        starts, stops = words(data)
        row = np.searchsorted(ends, starts, side="right")
        line = np.searchsorted(np.flatnonzero(data == NEWLINE), starts)
        last, grams = _wanted(row, carried)
        counts[first : first + n] += np.bincount(row[carried:], minlength=n)
        for k in range(GRAM):
            ok = grams[:, k]
            grams[ok, k] = line[last[ok]] != line[last[ok] - k]
        some = grams.any(axis=1)
        last, grams = last[some], grams[some]
        found = features(data, starts, stops, last, grams, buckets)
        per = np.bincount(row[last], weights=grams.sum(axis=1), minlength=n).astype(np.int64)
        for k, part in enumerate(np.split(found, np.cumsum(per)[:-1])):
            out[first + k].append(part)
    return counts, [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint16), *x]) for x in out]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def lines(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, n, found): each distinct line of ``texts`` (text) that has words, how often it occurs, and the buckets of its features.

    This is the only place where features inside lines are made: once for each distinct line.
    """
    each = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            # every row gets a separator, so that no word reaches into the next one
            column = pa.array([(x or "") + "\n" for x in batch.column(0).to_pylist()], pa.large_string())
            found = line_features(column, buckets)
            keys = [xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in batch.column(0).to_pylist()]
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "n", "found"])
            yield out.filter(pa.array([len(x) > 0 for x in found]))

    return stored(each.mapInArrow(run, "key binary, n long, found binary"), "lines")


def documents(docs: DataFrame, buckets: int) -> DataFrame:
    """(uid, id, n_words, found, keys, times): of each row of ``docs`` (id, text) its features over newlines and its distinct lines with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [x or "" for x in batch.column(2).to_pylist()]
            counts, found = cross_features(pa.array([x + "\n" for x in texts], pa.large_string()), buckets)
            keys, times = [], []
            for text in texts:
                seen: dict[bytes, int] = {}
                for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                    if WORDY.search(line):  # a blank line has no features, and would be the most common key
                        seen[line] = seen.get(line, 0) + 1
                keys.append([xxhash.xxh3_128_digest(x) for x in seen])
                times.append(list(seen.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array([x.tobytes() for x in found], pa.binary()),
                 pa.array(keys, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["uid", "id", "n_words", "found", "keys", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "id", "text")
    return stored(rows.mapInArrow(run, "uid long, id long, n_words long, found binary, keys array<binary>, times array<long>"), "cross")


def bucket_counts(parts: list[DataFrame], buckets: int) -> np.ndarray:
    """How often each bucket is found in ``parts`` (found, n: times that a row counts); one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            found = [np.frombuffer(x, dtype=np.uint16) for x in batch.column(0).to_pylist()]
            if not found:
                continue
            times = np.repeat(np.asarray(batch.column(1), dtype=np.int64), [len(x) for x in found])
            at = np.concatenate(found)
            for shift in (0, 24, 48):  # parts of 24 bits add up exactly in doubles
                part = times >> shift & 0xFFFFFF
                if part.any():
                    sums += np.bincount(at, weights=part, minlength=buckets).astype(np.int64) << shift
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], ["bucket", "n"])

    every = reduce(DataFrame.union, [p.select("found", F.col("n").cast("long")) for p in parts])
    total = np.zeros(buckets, dtype=np.int64)
    for row in every.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, both smoothed by one count a bucket."""
    s_all, t_all, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with w, the sum of the gains of the buckets in found, in its place. One number a bucket goes to the tasks."""
    cols = [c for c in rows.columns if c != "found"]
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            w = [int(gain[np.frombuffer(x, dtype=np.uint16)].sum()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(w, pa.int64())], [*cols, "w"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.select(*cols).dtypes)
    return rows.select(*cols, "found").mapInArrow(run, schema + ", w long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = 10000, percent: int = 5, min_words: int = 20, seed: int = 42,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: ``percent`` of those with ``min_words`` words are drawn without
    replacement, in proportion to how much likelier ``target`` makes their n-grams (Gumbel scores; rank 1 first, null: not drawn).

    Features are runs of 1 to 3 words (A-Z lower-cased; separators are all other ASCII but digits and
    a-z), joined by a space and counted in ``buckets`` by CRC-32. Newlines are separators that cut a
    text into lines. A distinct line's features are made once over the whole corpus, stored, and
    multiplied by its occurrences; features that reach over a newline are made per text and added.
    A text's weight is the sum over its lines of the stored lines' gains, and those of its own. A line that
    a large part of the corpus shares is joined by broadcast (at most 1000 lines can be that common),
    all others by a shuffle of one key for each text and distinct line.

    Null and empty texts have no features and weight zero. Rows of one id are scored each on its own and, in ties,
    stand in no fixed order. A null id has no score, is never drawn and not counted. An empty ``docs``
    gives no rows; an empty ``target`` is a target without counts. Other columns don't matter.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(target_col).cast("string").alias("text"))
    kept, each = lines(rows, buckets), documents(rows, buckets)
    once = F.lit(1).alias("n")
    source = bucket_counts([kept, each.select("found", once)], buckets)
    aim = bucket_counts([lines(wanted, buckets), documents(wanted, buckets).select("found", once)], buckets)
    gain = gains(source, aim)

    total = kept.agg(F.sum("n").alias("n")).first()["n"] or 0
    met = each.select("uid", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("uid", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    inner = hot_join(met, weighed(kept, gain), "key", "n", total).select("uid", (F.col("w") * F.col("times")).alias("w"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("n_words"))
    own = weighed(each.select("uid", "id", "n_words", "found"), gain)
    n = F.max("n_words").alias("n_words")
    scored = own.select("uid", "w", "id", "n_words").union(inner).groupBy("uid").agg(F.max("id").alias("id"), n, F.sum("w").alias("weight"))

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    count = reduce(lambda a, b: a + b, [F.greatest(F.col("n_words") - k, F.lit(0)) for k in range(GRAM)])
    fit = (F.col("n_words") >= min_words) & F.col("id").isNotNull()
    scored = cut_lineage(scored.select("uid", "id", count.alias("n_features"), "weight", (F.col("weight") + noise).alias("score"), fit.alias("fit")))
    draw = scored.where("fit").count() * percent // 100
    order = [F.desc("fit"), F.desc_nulls_last("score"), F.asc("id"), F.asc("uid")]
    ranked = ranged_totals(scored, [], order, F.lit(1), "place")
    rank = F.when(F.col("fit") & (F.col("place") <= draw), F.col("place"))
    return ranked.select("id", F.col("n_features").cast("long"), "weight", F.col("score").cast("long"), rank.cast("long").alias("rank"))
