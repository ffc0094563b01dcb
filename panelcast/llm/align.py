"""Alignment of the tokens of two tokenizers over the bytes of a text, by products of sparse incidence matrices."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage, scratch_path

#: Distinct segments that a block of texts may hold before it is closed.
SEGMENTS = 300_000
#: Characters of a text that are cut into segments at a time.
PART = 1 << 22
#: Characters of texts that are aligned together.
CHARS = 1 << 20
#: A blank that follows no white space, all white space after it, and what follows up to the next such blank.
SEGMENT = re.compile(r" \s*(?:\S+(?:[^\S ]\s*|\s+\Z)?)*")
#: A place where a text may be cut in front of a segment.
EDGE = re.compile(r"(?<=\S) (?=\S)")

Csr = tuple[np.ndarray, np.ndarray]


# sparse matrices of ones, as (row starts, column of each entry)


def by_lengths(lengths: np.ndarray) -> Csr:
    """Matrix whose row i has the next lengths[i] columns: tokens by their bytes."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return starts, np.arange(starts[-1])


def by_labels(labels: np.ndarray) -> Csr:
    """Matrix with one entry a row, in the column that ``labels`` names: tokens by their group."""
    return np.arange(len(labels) + 1), labels.astype(np.int64)


def transposed(m: Csr, columns: int) -> Csr:
    """Rows and columns exchanged, by counting the entries of each column."""
    starts, cols = m
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(cols, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=columns))]).astype(np.int64), rows[order]


def product(a: Csr, b: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, columns, values) of A B by rows: row i is the sum of the rows of B that row i of A names.

    All rows of A are worked on at once: the named rows of B are laid end to end, and entries of one
    row and column are added up.
    """
    (a_starts, a_cols), (b_starts, b_cols) = a, b
    rows = len(a_starts) - 1
    sizes = (b_starts[1:] - b_starts[:-1])[a_cols]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(b_starts[a_cols] - (ends - sizes), sizes)
    row = np.repeat(np.repeat(np.arange(rows), np.diff(a_starts)), sizes)
    key = row * max(1, columns) + b_cols[at]
    key.sort(kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, dtype=np.int64)
    values = np.diff(np.concatenate([first, [total]]))
    row, col = np.divmod(key[first], max(1, columns))
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int64), col, values


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, bytes): tokens of two cuts of the same bytes that share bytes, by (A bytes) (B bytes)^T."""
    starts, b, shared = product(by_lengths(a_len), transposed(by_lengths(b_len), int(a_len.sum())), len(b_len))
    return np.repeat(np.arange(len(a_len)), np.diff(starts)), b, shared


def groups(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, group of each A token, group of each B token): bytes where tokens of both end cut them into groups."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    return ends, np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)


def group_links(a_group: np.ndarray, b_group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): tokens of one group, by (A groups) (B groups)^T."""
    starts, b, _ = product(by_labels(a_group), transposed(by_labels(b_group), n_groups), len(b_group))
    return np.repeat(np.arange(len(a_group)), np.diff(starts)), b


# tokens


class Tokenizers:
    """Ids of segments by a byte-level BPE file (A) and a piece model that puts a blank in front (B), and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary, kind = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        merges = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"] or sorted(merges) != merges:
            raise ValueError(f"{a_path} is no plain byte-level BPE file whose ids follow its merges")
        shown = [c for c in range(256) if chr(c).isprintable() and c not in (0x20, 0xA0, 0xAD) and c != 0x7F]
        back = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        # the merges make the tokens in the order of their ids, so ids are ranks
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_len = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.a_len[i] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            b"" if self.b.is_control(i) else bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # no piece goes on into another word, so a text may be encoded in parts that begin with a blank
        as_it_is = b"".join(self.b_bytes[i] for i in self.b.encode(" a  b\t")) == b"  a  b\t"
        self.apart = as_it_is and not any(re.search("[^▁]▁", p) for p in pieces)

    def segments(self, text: str) -> Iterator[list[str]]:
        """A blank and the text in segments that both tokenizers cut apart too, a bounded number of characters at a time."""
        full, at = " " + text, 0
        if not self.apart:
            yield [full]
            return
        while at < len(full):
            edge = EDGE.search(full, at + PART)
            stop = edge.start() if edge else len(full)
            yield SEGMENT.findall(full, at, stop)
            at = stop

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """A ids, B ids and whether the B bytes are those of the segment (those of A always are)."""
        a = [self.a.encode_ordinary(s) for s in segments]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        spell = self.b_bytes.__getitem__
        return a, b, [b"".join(map(spell, ids)) == s.encode() for s, ids in zip(segments, b, strict=True)]

    def sound(self, text: str) -> bool:
        """Whether the B bytes of the text are those of the text, and it is not empty."""
        return bool(text) and all(all(self.encode(list(set(part)))[2]) for part in self.segments(text))


@cache
def tokenizers(a_path: str, b_path: str, pattern: str) -> Tokenizers:
    return Tokenizers(a_path, b_path, pattern)


class Aligned:
    """The distinct segments of a block of texts, each aligned once: counts, groups as text and id pairs of its links."""

    def __init__(self, tok: Tokenizers) -> None:
        self.tok = tok
        self.index: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts = np.zeros((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links of each segment
        self.times = np.zeros(0, dtype=np.int64)
        self.pairs: list[np.ndarray] = []
        self.bad: set[int] = set()

    def add(self, segments: set[str]) -> None:
        """Aligns segments that are not there yet, all in one matrix product."""
        new = sorted(segments.difference(self.index))
        if not new:
            return
        first = len(self.index)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        a, b, same = self.tok.encode(new)
        if not all(same):
            self.bad.update(first + k for k, ok in enumerate(same) if not ok)
            a = [x if ok else [] for x, ok in zip(a, same, strict=True)]
            b = [x if ok else [] for x, ok in zip(b, same, strict=True)]
        n_a, n_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(new)) for x in (a, b))
        a_ids, b_ids = (np.fromiter((i for x in y for i in x), dtype=np.int64) for y in (a, b))
        a_len, b_len = self.tok.a_len[a_ids], self.tok.b_len[b_ids]
        ends, a_group, b_group = groups(a_len, b_len)
        link_a, link_b, _ = overlaps(a_len, b_len)
        a_seg = np.repeat(np.arange(len(new)), n_a)
        group_seg = np.zeros(len(ends), dtype=np.int64)
        group_seg[a_group] = a_seg
        n_groups, n_links = (np.bincount(x, minlength=len(new)) for x in (group_seg, a_seg[link_a]))
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, n_groups, n_links])])
        self.times = np.concatenate([self.times, np.zeros(len(new), dtype=np.int64)])
        self.pairs.append(a_ids[link_a] << 32 | b_ids[link_b])
        self.shown.extend(shown(a_ids, b_ids, a_group, b_group, n_groups))

    def rows(self) -> Iterator[dict[str, list]]:
        """Columns of kind 0 and 1 of STORED."""
        if not len(self.counts):
            return
        sizes, pairs = self.counts[:, 3], np.concatenate(self.pairs)
        names, where = np.unique(pairs, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(len(names)))
        counts = np.add.reduceat(np.repeat(self.times, sizes)[order], bounds) if len(names) else np.zeros(0, dtype=np.int64)
        met = counts > 0
        names, counts = names[met], counts[met]
        for at in range(0, len(names), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield {"kind": [0] * len(names[part]), "key": names[part], "n": counts[part]}
        for at in range(0, len(sizes), 1 << 15):
            stop = min(len(sizes), at + (1 << 15))
            yield {"kind": [1], "key": [at], "first": [sizes[at:stop].tobytes()], "second": [pairs[starts[at] : starts[stop]].tobytes()]}


def shown(a_ids: np.ndarray, b_ids: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_groups: np.ndarray) -> Iterator[str]:
    """``a1,a2|b1;a3|b2`` of each segment."""
    total = int(n_groups.sum())
    a_words, b_words = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    a_cut, b_cut = ([0, *accumulate(np.bincount(g, minlength=total).tolist())] for g in (a_group, b_group))
    each = (f"{','.join(a_words[s:e])}|{','.join(b_words[t:f])}" for s, e, t, f in zip(a_cut, a_cut[1:], b_cut, b_cut[1:], strict=False))
    for n in n_groups.tolist():
        yield ";".join(islice(each, n))


# the corpus

#: What tokenizing writes: rows of kind 0 are id pairs of a block, kind 1 the links of its segments, kind 2 its texts.
STORED = pa.schema([
    ("block", pa.int64()), ("kind", pa.int32()), *((c, pa.int64()) for c in ("key", "n", "uid", "id", "n_a", "n_b", "n_groups", "n_links")),
    ("groups_sha256", pa.string()), ("first", pa.binary()), ("second", pa.binary()),
])
SPARK_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}


def _batch(schema: pa.Schema, columns: dict[str, list], **same: int) -> pa.RecordBatch:
    """Columns that are not given hold nulls; ``same`` are numbers that all rows share."""
    n = len(next(iter(columns.values())))
    columns = columns | {k: [v] * n for k, v in same.items()}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SPARK_NAMES[f.type]}" for f in schema)


def aligned_blocks(rows: DataFrame, a_path: str, b_path: str, pattern: str, segments: int = SEGMENTS) -> DataFrame:
    """Blocks of the texts of ``rows`` (uid, id, text), as STORED says.

    A block is a run of texts of one task; it ends when it holds ``segments`` distinct segments. Its
    texts name segments by their number in the block, so a text is a sparse row over segments, and
    a segment one over id pairs. A long text may go on in the next block: it has a row in each.
    """
    names = ("uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, block = tokenizers(a_path, b_path, pattern), TaskContext.get().partitionId() << 32
        done, texts = Aligned(tok), []

        def take(parts: list[tuple[int, int | None, list[str], hashlib._Hash, bool]]) -> None:
            """Rows of texts or parts of texts; the digest is given with the last part."""
            done.add({s for part in parts for s in part[2]})
            for uid, name, part, digest, last in parts:
                at = np.fromiter(map(done.index.__getitem__, part), dtype=np.int64, count=len(part))
                if done.bad and not done.bad.isdisjoint(at.tolist()):
                    texts.append((uid, name, *none))
                    continue
                which, often = np.unique(at, return_counts=True)
                done.times[which] += often
                digest.update(";".join(map(done.shown.__getitem__, at.tolist())).encode())
                if not last:
                    digest.update(b";")
                sums = (often @ done.counts[which]).tolist()
                texts.append((uid, name, *sums, digest.hexdigest() if last else None, which.astype(np.uint32).tobytes(), often.astype(np.uint32).tobytes()))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, texts, block
            if texts:
                yield _batch(STORED, dict(zip(names, zip(*texts, strict=True), strict=True)) | {"key": [0] * len(texts)}, block=block, kind=2)
                texts = []
            if len(done.index) >= segments:
                for columns in done.rows():
                    yield _batch(STORED, columns, block=block)
                done, block = Aligned(tok), block + 1

        none, waiting, size = (0, 0, 0, 0, "", b"", b""), [], 0
        for rows in batches:
            for uid, name, text in zip(*(rows.column(k).to_pylist() for k in range(3)), strict=True):
                if not text or (len(text) > PART and not tok.sound(text)):
                    texts.append((uid, name, *none))
                elif len(text) > PART:
                    digest, parts = hashlib.sha256(), tok.segments(text)
                    part = next(parts)
                    while part is not None:
                        after = next(parts, None)
                        take([(uid, name, part, digest, after is None)])
                        yield from flush()
                        part = after
                else:
                    waiting.append((uid, name, next(tok.segments(text)), hashlib.sha256(), True))
                    size += len(text)
                    if size >= CHARS:
                        take(waiting)
                        waiting, size = [], 0
                        yield from flush()
        take(waiting)
        segments_left, done_now = len(done.index), done
        yield from flush()
        if segments_left and done is done_now:
            for columns in done.rows():
                yield _batch(STORED, columns, block=block)

    return rows.select("uid", "id", "text").mapInArrow(run, ddl(STORED))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(key, total, best): how many links hold each id pair (A id, B id in the upper and lower half of key), and whether no pair of its B id has more."""
    totals = blocks.where("kind = 0").groupBy("key").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("key").bitwiseAND(0xFFFFFFFF))  # at most one row for each A id
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def scored_texts(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text row of ``blocks``.

    Each block gets the counts of its own pairs, then those of its segments, then of its texts. A pair has
    one row a block in the join, so none is hot; a task holds the pairs and segments of one block.
    """
    pairs = blocks.where("kind = 0").select("block", "key").hint("merge").join(counts.hint("merge"), "key")
    pairs = pairs.select("block", F.lit(0).alias("kind"), "key", F.col("total").alias("n"), F.col("best").cast("long").alias("n_best"))
    rows = pairs.unionByName(blocks.where("kind > 0").drop("n"), allowMissingColumns=True)
    order = ["block", "kind", "key"]
    given = ["n", "n_best", "uid", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "first", "second"]
    out = pa.schema([*((c, pa.int64()) for c in ("uid", "id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, per_pair, per_segment = None, [], None, None, []
        for batch in batches:
            block, kind = (np.asarray(batch.column(k), dtype=np.int64) for k in (0, 1))
            cuts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])) if len(block) else []
            for s, e in zip(cuts, [*cuts[1:], len(block)], strict=True):
                if block[s] != now:
                    now, held, keys, per_segment = block[s], [], None, []
                part = batch.slice(s, e - s)
                column = dict(zip([*order, *given], part.columns, strict=True))
                if kind[s] == 0:
                    held.append(np.stack([np.asarray(column[c], dtype=np.int64) for c in ("key", "n", "n_best")]))
                    continue
                if keys is None:
                    keys, *per_pair = np.concatenate([np.zeros((3, 0), dtype=np.int64), *held], axis=1)
                    per_pair, held = np.stack([per_pair[1], per_pair[0]], axis=1), []
                if kind[s] == 1:
                    for sizes, pairs in zip(column["first"].to_pylist(), column["second"].to_pylist(), strict=True):
                        per_segment.append(_row_sums(np.frombuffer(sizes, dtype=np.int64), np.frombuffer(pairs, dtype=np.int64), keys, per_pair))
                    continue
                table = per_segment[0] if len(per_segment) == 1 else np.concatenate([np.zeros((0, 2), dtype=np.int64), *per_segment])
                per_segment = [table]
                sums = np.zeros((part.num_rows, 2), dtype=np.int64)
                for k, (which, often) in enumerate(zip(column["first"].to_pylist(), column["second"].to_pylist(), strict=True)):
                    if which:
                        sums[k] = np.frombuffer(often, dtype=np.uint32).astype(np.int64) @ table[np.frombuffer(which, dtype=np.uint32)]
                column |= {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
                yield pa.RecordBatch.from_arrays([column[f.name] for f in out], schema=out)

    sorted_rows = rows.select(*order, *given).repartition("block").sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(run, ddl(out))


def _row_sums(sizes: np.ndarray, pairs: np.ndarray, keys: np.ndarray, per_pair: np.ndarray) -> np.ndarray:
    """Sums of ``per_pair`` over the pairs of each segment; pairs outside ``keys`` stand in no text and count nothing."""
    if not len(keys):
        return np.zeros((len(sizes), 2), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    values = np.where((keys[at] == pairs)[:, None], per_pair[at], 0)
    before = np.concatenate([np.zeros((1, 2), dtype=np.int64), np.cumsum(values, axis=0)])
    ends = np.cumsum(sizes)
    return before[ends] - before[ends - sizes]


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``: the tokens of a
    byte-level BPE file (A) and a piece model (B) over a blank and the text, aligned by bytes.

    Token-byte matrices A and B give the links A B^T (tokens that share bytes); bytes where tokens of both
    end cut them into groups. A link's count is how many links of the corpus hold its id pair; n_best
    are the links whose pair has the highest count of its B id, count_sum adds the counts up.
    Segments that both tokenizers cut apart are aligned once a block (``aligned_blocks``).

    Texts that are null or empty, or whose B bytes differ from blank and text, have zeros and the digest ''. Rows
    of one id are texts of their own. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "alignment")
    aligned_blocks(rows, a_path, b_path, pattern, segments).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    parts = scored_texts(blocks, cut_lineage(pair_counts(blocks)))
    sums = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    whole = parts.groupBy("uid").agg(F.max("id").alias("id"), *sums, F.max("groups_sha256").alias("groups_sha256"))
    return whole.drop("uid")


def links(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", shared_group: bool = False) -> DataFrame:
    """(id, a, b, a_id, b_id, bytes) for each link of every text: places and ids of the tokens, and the bytes they share.

    With ``shared_group`` the links are those of tokens in one group, by the product of the group incidence
    matrices, overlapping or not (bytes is then 0 where they don't). Texts without tokens give no rows.
    """
    out = pa.schema([(c, pa.int64()) for c in ("id", "a", "b", "a_id", "b_id", "bytes")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(a_path, b_path, pattern)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or (len(text) > PART and not tok.sound(text)):
                    continue
                before_a = before_b = 0
                for part in tok.segments(text):
                    a, b, same = tok.encode(part)
                    if not all(same):
                        break
                    a_ids, b_ids = (np.fromiter((i for x in y for i in x), dtype=np.int64) for y in (a, b))
                    a_len, b_len = tok.a_len[a_ids], tok.b_len[b_ids]
                    la, lb, shared = overlaps(a_len, b_len)
                    if shared_group:
                        ends, a_group, b_group = groups(a_len, b_len)
                        ga, gb = group_links(a_group, b_group, len(ends))
                        key, wanted = la * len(b_ids) + lb, ga * len(b_ids) + gb
                        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                        la, lb, shared = ga, gb, np.where(key[at] == wanted, shared[at], 0)
                    columns = [la + before_a, lb + before_b, a_ids[la], b_ids[lb], shared]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(la), pa.int64()), *(pa.array(c.astype(np.int64)) for c in columns)], schema=out)
                    before_a, before_b = before_a + len(a_ids), before_b + len(b_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ddl(out))
