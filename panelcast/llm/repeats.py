"""Removal of long repeated byte strings by recursive induction over sampled suffixes.

A suffix stands for the window of LENGTH bytes it starts with. Each window is represented by its
sample suffix, the position inside it whose K-byte gram has the least hash; equal windows have equal
samples at equal offsets, and a sample stands for a run of neighbouring windows (about W / 2). Tuples
(gram name, name of all bytes around the sample, text, position) are sorted by Spark's external
sort. Neighbours in that order settle most of them at once: a sample whose gram occurs once shares no
prefix of LENGTH bytes with another suffix, nor do its windows; one whose whole surroundings occur
twice makes all its windows repeats. Only the others are induced further: the windows of a gram's
samples are compared offset by offset in one task, and a gram with more samples than a task should
hold is refined into blocks of windows, then into single windows, under longer common prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a repeat.
LENGTH = 200
#: Samples of a gram that one task compares.
CLASS = 4096
#: Window offsets in a block of the second round.
BLOCK = 16
#: Windows whose samples are found at a time.
STEP = 1 << 17

TUPLE = "key long, kind int, h1 long, h2 long, at long, body binary"
#: Kinds of tuples: undecided, decided partners of undecided ones, and verdicts.
OPEN, PARTNER, DONE = 0, 1, 2


def span(length: int) -> int:
    """Windows a sample can stand for (W); grams have length - W + 1 bytes."""
    return min(128, max(1, length * 16 // 25))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, np.uint64(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return up, down, np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64)


def samples(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, least offset, largest offset, gram name) of the samples of all windows, in text order.

    A sample at a stands for the windows that start at a - largest to a - least. Of equal grams in a
    window the leftmost is taken, so the choice depends on the bytes of the window alone.
    """
    w = span(length)
    k = length - w + 1
    windows = len(text) - length + 1
    starts, places, names = [], [], []
    last = -1
    for at in range(0, max(0, windows), STEP):
        count = min(STEP, windows - at)
        b = np.frombuffer(text, dtype=np.uint8, count=count + length - 1, offset=at)
        up, down, salt = _powers(STEP + length)
        sums = np.cumsum(salt[b] * up[: len(b)], dtype=np.uint64)
        grams = sums[k - 1 :].copy()
        grams[1:] -= sums[: len(b) - k]
        grams *= down[: len(grams)]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        ranked = np.full(-(-len(grams) // w) * w, np.uint64((1 << 64) - 1))
        ranked[: len(grams)] = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
        blocks = ranked.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:count]
        behind = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 : w - 1 + count]
        place = (np.minimum(ahead, behind) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        if place[0] + at == last:
            first = first[1:]
        last = int(place[-1]) + at
        starts.append(first + at)
        places.append(place[first] + at)
        names.append(grams[place[first]])
    if not starts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    start, place, name = (np.concatenate(x) for x in (starts, places, names))
    end = np.r_[start[1:], windows] - 1
    return place, place - end, place - start, name


def _pack(a, least, most):
    return (a << 16) | (least << 8) | most


def _unpack(at: int) -> tuple[int, int, int]:
    return at >> 16, (at >> 8) & 255, at & 255


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of (start, end) rows as maximal runs."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    return np.column_stack([spans[at, 0], reach[np.r_[at[1:], len(spans)] - 1]])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Each distinct text once, with its number of copies: (h1, h2, text binary, n)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(*_names(text_col), text.alias("text")).groupBy("h1", "h2").agg(F.max("text").alias("text"), F.count("*").alias("n"))


def _names(text_col: str):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def _tuples(texts: DataFrame, length: int) -> DataFrame:
    """One row for each sample: (gram, around, h1, h2, at); ``at`` is odd for texts with copies, which are decided.

    Samples that agree in gram and surroundings inside a batch settle each other there: they pass on
    with a negative ``at``, and one of them stays as a decided row for the other batches. So a string
    that fills many texts, or a text with a short period, sends a row for each batch and not for each place.
    """
    w = span(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            for h1, h2, cell, n in zip(*(batch.column(c) for c in range(4)), strict=True):
                text = cell.as_py()
                place, least, most, gram = samples(text, length)
                if not len(place):
                    continue
                h1, h2 = h1.as_py(), h2.as_py()
                seed = (h1 ^ (h2 << 1)) & ((1 << 64) - 1)
                around = [
                    xxhash.xxh3_64_intdigest(text[a - w + 1 : a + length]) if a >= w - 1 and a + length <= len(text) else xxhash.xxh3_64_intdigest(a.to_bytes(8, "little"), seed)
                    for a in place.tolist()
                ]
                found = (gram.view(np.int64), np.array(around, dtype=np.uint64).view(np.int64), np.full(len(place), h1), np.full(len(place), h2), (_pack(place, least, most) << 1) | (n.as_py() > 1))
                for store, x in zip(cols, found, strict=True):
                    store.append(x)
            if cols[0]:
                gram, around, h1, h2, at = (np.concatenate(c) for c in cols)
                order = np.lexsort((around, gram))
                same = np.r_[False, (gram[order][1:] == gram[order][:-1]) & (around[order][1:] == around[order][:-1])]
                twice = np.zeros(len(gram), dtype=bool)
                twice[order] = same | np.r_[same[1:], False]
                later = np.zeros(len(gram), dtype=bool)
                later[order] = same
                sure = np.flatnonzero(twice & (at & 1 == 0))
                at_sure = -1 - at[sure]
                at = np.where(twice, at | 1, at)
                rest = np.flatnonzero(~later)
                out = [np.concatenate([x[rest], y]) for x, y in ((gram, h1[sure]), (around, h2[sure]), (h1, h1[sure]), (h2, h2[sure]), (at, at_sure))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["gram", "around", "h1", "h2", "at"])

    return texts.where(F.octet_length("text") >= length).mapInArrow(run, "gram long, around long, h1 long, h2 long, at long")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, code) of the samples that matter, from a stream sorted by (gram, around).

    code is at * 4 plus: 0 undecided, 1 partner of undecided ones, 2 all windows repeat, 3 both. One
    row is held back, to see the next; a gram with one kind of surroundings needs no partners.
    """
    gram = around = None
    later = False  # whether the run of the last row is not the first of its gram
    held: list[pa.RecordBatch] = []

    def decide(table: pa.Table, n: int) -> pa.RecordBatch:
        nonlocal gram, around, later
        g, s, h1, h2, at = (table.column(c).to_numpy() for c in range(5))
        m = len(g)
        same_g, same_s = np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=bool)
        same_g[1:m] = g[1:] == g[:-1]
        same_s[1:m] = same_g[1:m] & (s[1:] == s[:-1])
        same_g[0] = gram is not None and g[0] == gram
        same_s[0] = same_g[0] and s[0] == around
        i = np.arange(m)
        class_at = np.maximum.accumulate(np.where(~same_g[:m], i, -1))
        run_at = np.maximum.accumulate(np.where(~same_s[:m], i, -1))
        not_first = np.where(class_at >= 0, run_at != class_at, np.where(run_at >= 0, True, later))
        last = ~same_s[1:]
        multi = last & (not_first | same_g[1:])
        twice = same_s[:m] | same_s[1:]
        copies = (at & 1).astype(bool)
        code = np.full(m, -1)
        code[multi & ~twice & ~copies] = 0
        code[multi & copies] = 1
        code[twice & ~copies] = 2
        code[twice & ~copies & multi] = 3
        gram, around, later = g[n - 1], s[n - 1], bool(not_first[n - 1])
        keep = np.flatnonzero(code[:n] >= 0)
        return pa.RecordBatch.from_arrays([pa.array(h1[keep]), pa.array(h2[keep]), pa.array((at[keep] >> 1 << 2) | code[keep])], ["h1", "h2", "code"])

    for batch in batches:
        at = batch.column("at").to_numpy()
        if (sure := at < 0).any():
            done = batch.filter(pa.array(sure))
            yield pa.RecordBatch.from_arrays([done.column("h1"), done.column("h2"), pa.array((-1 - at[sure] >> 1 << 2) | 2)], ["h1", "h2", "code"])
            batch = batch.filter(pa.array(~sure))
        if batch.num_rows:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            held = table.slice(table.num_rows - 1).to_batches()
            if table.num_rows > 1:
                yield decide(table, table.num_rows - 1)
    if held:
        yield decide(pa.Table.from_batches(held), 1)


def _emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "kind", "h1", "h2", "at", "body"])
        rows.clear()


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _expand(length: int):
    """Tuples with the bytes of their windows, and one verdict for the settled samples of a text."""
    k = length - span(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for h1, h2, cell, codes in zip(*(batch.column(c) for c in ("h1", "h2", "text", "codes")), strict=True):
                text, h1, h2 = cell.as_py(), h1.as_py(), h2.as_py()
                codes = codes.values.to_numpy()
                at, code = codes >> 2, codes & 3
                sure = at[code >= 2]
                if len(sure):
                    a, least, most = sure >> 16, (sure >> 8) & 255, sure & 255
                    spans = merged(np.column_stack([a - most, a - least + length]))
                    rows.append((h1, DONE, h1, h2, 0, spans.astype("<i8").tobytes()))
                for x, c in zip(at[code != 2].tolist(), code[code != 2].tolist(), strict=True):
                    a, least, most = _unpack(x)
                    rows.append((_signed(xxhash.xxh3_64_intdigest(text[a : a + k])), PARTNER if c else OPEN, h1, h2, x, text[a - most : a - least + length]))
                if len(rows) > 20_000:
                    yield from _emit(rows)
        yield from _emit(rows)

    return run


def _windows(members: list[tuple], length: int) -> Iterator[tuple]:
    """Verdicts for the undecided tuples of one class: a window repeats if another member has it at its offset."""
    seen: dict[tuple[int, bytes], int] = {}
    for _, _, _, _, at, body in members:
        _, least, most = _unpack(at)
        for o in range(least, most + 1):
            window = (o, body[most - o : most - o + length])
            seen[window] = seen.get(window, 0) + 1
    for key, kind, h1, h2, at, body in members:
        if kind == OPEN:
            a, least, most = _unpack(at)
            starts = np.array([a - o for o in range(most, least - 1, -1) if seen[o, body[most - o : most - o + length]] > 1], dtype="<i8")
            if len(starts):
                yield key, DONE, h1, h2, 0, merged(np.column_stack([starts, starts + length])).astype("<i8").tobytes()


def _children(member: tuple, length: int, block: int) -> Iterator[tuple]:
    """The member's windows in blocks of offsets, each named by the bytes that all windows of the block share."""
    _, kind, h1, h2, at, body = member
    a, least, most = _unpack(at)
    for first in range(least // block * block, most + 1, block):
        low, high = max(first, least), min(first + block - 1, most)
        core = body[most - first : most - first - block + 1 + length]
        key = _signed(xxhash.xxh3_64_intdigest(core, first))
        part = body[most - high : most - low + length] if block > 1 else xxhash.xxh3_128_digest(core)
        yield key, kind, h1, h2, _pack(a, low, high), part


def _induce(length: int, block: int, limit: int):
    """Verdicts of the classes of up to ``limit`` tuples in a stream sorted by key; larger classes go on as smaller blocks.

    Of a class at most ``limit`` tuples are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        members: list[tuple] = []
        key, over = None, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == DONE:
                    out.append(row)
                    continue
                if row[0] != key:
                    if len(members) > 1:
                        out.extend(_windows(members, length))
                    members, key, over = [], row[0], False
                if not over:
                    members.append(row)
                    if len(members) > limit:
                        over = True
                        for m in members:
                            out.extend(_children(m, length, block))
                        members = []
                else:
                    out.extend(_children(row, length, block))
                if len(out) > 20_000:
                    yield from _emit(out)
        if len(members) > 1:
            out.extend(_windows(members, length))
        yield from _emit(out)

    return run


def _last(length: int):
    """Verdicts of single windows in a stream sorted by (key, digest): equal neighbours repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held, twice = None, False

        def verdict(row: tuple, repeats: bool) -> None:
            if repeats and row[1] == OPEN:
                a, least, _ = _unpack(row[4])
                out.append((row[0], DONE, row[2], row[3], 0, np.array([a - least, a - least + length], dtype="<i8").tobytes()))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1] == DONE:
                    out.append(row)
                    continue
                same = held is not None and row[0] == held[0] and row[5] == held[5]
                if held is not None:
                    verdict(held, twice or same)
                held, twice = row, same
            if len(out) > 20_000:
                yield from _emit(out)
        if held is not None:
            verdict(held, twice)
        yield from _emit(out)

    return run


def with_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, limit: int = CLASS) -> DataFrame:
    """``docs`` without the text column, with ``_text`` (bytes), ``_n`` (copies of the text) and ``_spans``: verdicts of its repeats.

    Texts are shuffled once by their hash, copies collapse before; samples, bytes and the result all
    read that one exchange. Keys never gather more than one text's samples or one class's bound.
    """
    texts = _texts(docs, text_col)
    settled = _tuples(texts, length).repartition("gram").sortWithinPartitions("gram", "around").mapInArrow(_settle, "h1 long, h2 long, code long")
    codes = settled.groupBy("h1", "h2").agg(F.collect_list("code").alias("codes"))
    tuples = texts.join(codes, ["h1", "h2"]).select("h1", "h2", "text", "n", "codes").mapInArrow(_expand(length), TUPLE)
    tuples = tuples.repartition("key").sortWithinPartitions("key").mapInArrow(_induce(length, BLOCK, limit), TUPLE)
    tuples = tuples.repartition("key").sortWithinPartitions("key").mapInArrow(_induce(length, 1, limit), TUPLE)
    tuples = tuples.repartition("key").sortWithinPartitions("key", "body").mapInArrow(_last(length), TUPLE)
    spans = tuples.groupBy("h1", "h2").agg(F.collect_list("body").alias("_spans"))
    rows = docs.select(*(c for c in docs.columns if c != text_col), F.col(text_col).isNull().alias("_null"), *_names(text_col))
    return rows.join(texts.withColumnsRenamed({"text": "_text", "n": "_n"}), ["h1", "h2"]).join(spans, ["h1", "h2"], "left").drop("h1", "h2")


def removed(size: int, copies: int, spans: list[bytes] | None, length: int = LENGTH) -> np.ndarray:
    """Maximal removed runs of a text of ``size`` bytes, as (start, end) rows."""
    if copies > 1 and size >= length:
        return np.array([[0, size]], dtype=np.int64)
    if not spans:
        return np.zeros((0, 2), dtype=np.int64)
    return merged(np.frombuffer(b"".join(spans), dtype="<i8").reshape(-1, 2))


def kept(text: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(text)]
    return b"".join(text[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def whole_characters(text: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs drawn in so that no character is cut."""
    out = []
    for s, e in runs.tolist():
        while s < e and text[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each document without the strings of ``length`` bytes that start anywhere else too.

    A null text is empty; a text shorter than ``length`` keeps all. Repeated rows are copies of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, cell, n, spans in zip(*(batch.column(c) for c in ("id", "_text", "_n", "_spans")), strict=True):
                text = cell.as_py()
                runs = removed(len(text), n.as_py(), spans.as_py(), length)
                rows.append((name.as_py(), len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept(text, runs)).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", length)
    return found.select("id", "_text", "_n", "_spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings taken out of the text, but no character cut; a null text stays null, every row stays, whatever the names of its columns."""
    cols = [f"c{k}" for k in range(len(docs.columns))]
    text_col, kinds = cols[docs.columns.index(text_col)], [t for _, t in docs.dtypes]
    found = with_spans(docs.toDF(*cols), text_col, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for null, cell, n, spans in zip(*(batch.column(c) for c in ("_null", "_text", "_n", "_spans")), strict=True):
                text = cell.as_py()
                runs = whole_characters(text, removed(len(text), n.as_py(), spans.as_py(), length))
                texts.append(None if null.as_py() else kept(text, runs).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in cols], cols)

    schema = ", ".join(f"{n} {'string' if n == text_col else t}" for n, t in zip(cols, kinds, strict=True))
    return found.mapInArrow(run, schema).toDF(*docs.columns)
