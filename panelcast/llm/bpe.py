"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens a task remembers.
REMEMBERED = 600_000
#: Texts of these characters only are split by the standard library's faster matcher.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
MASK = (1 << 64) - 1


def plain_pattern(pattern: str) -> str:
    """``pattern`` with the letters and digits of plain text spelt out in place of their Unicode properties."""
    letters, digits = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9"
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", letters).replace(r"\p{N}", digits), pattern)
    return inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")


def _mix(h: int, d: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
    return x ^ (x >> 29)


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys fill n slots.

    Keys fall in about n / 2 buckets; for each bucket, the largest first, a displacement is looked up
    that sends all its keys to free slots. Buckets of one key name their slot outright.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.r = len(keys), max(1, len(keys) // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            buckets.setdefault(h % self.r, []).append(i)
        slots, free, self.moves = [-1] * self.n, set(range(self.n)), [0] * self.r
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                at = [free.pop()]
                self.moves[b] = -1 - at[0]
            else:
                d = 0
                while True:
                    at = [_mix(hashes[i], d) % self.n for i in members]
                    if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                        break
                    d += 1
                self.moves[b] = d
            for i, s in zip(members, at, strict=True):
                slots[s] = i
                free.discard(s)
        self.keys = [keys[i] for i in slots]
        self.order = slots

    def find(self, key: bytes) -> int:
        """Index of ``key`` in the list it was built from, -1 if it is not there."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.r]
        s = -1 - d if d < 0 else _mix(h, d) % self.n
        return self.order[s] if self.keys[s] == key else -1


class Spelt(dict):
    """Comma-joined ids of the pre-tokens met so far; one not met yet is spelt."""

    def __init__(self, spell: Callable[[str], str]) -> None:
        super().__init__()
        self.spell = spell

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[token] = self.spell(token)
        return ids


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, tokens: list[tuple[bytes, int]], pattern: str) -> None:
        self.hash = PerfectHash([t for t, _ in tokens])
        self.ids = [i for _, i in tokens]
        self.ranks = dict(tokens)
        self.pattern = pattern
        self.spelt = {str(i): t for t, i in tokens}
        self.known = Spelt(self.spell)
        self.split = self.plain = None

    @staticmethod
    def from_file(path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return ByteBpe([(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)], pattern)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "split": None, "plain": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, known=Spelt(self.spell))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: the least rank, leftmost first, is merged until none is left.

        Parts are linked by where they start and end; the heap has one number for each pair, and a pair
        that has changed since no longer has the rank it was pushed with.
        """
        n, ranks = len(piece), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [ranks.get(piece[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [r * n + i for i, r in enumerate(pair) if r is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            end = after[i] = after[j]
            pair[j] = None
            if end < n:
                before[end] = i
                pair[i] = r = ranks.get(piece[i : after[end]])
                if r is not None:
                    heappush(heap, r * n + i)
            else:
                pair[i] = None
            if (k := before[i]) >= 0:
                pair[k] = r = ranks.get(piece[k:end])
                if r is not None:
                    heappush(heap, r * n + k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def spell(self, token: str) -> str:
        """Comma-joined ids of one pre-token."""
        piece = token.encode("utf-8", "surrogatepass")
        whole = self.hash.find(piece)
        return str(self.ids[whole]) if whole >= 0 else ",".join(map(str, self.merge(piece)))

    def encode(self, text: str) -> str:
        """Comma-joined ids of a whole text."""
        if self.split is None:
            self.split, self.plain = regex.compile(self.pattern).findall, re.compile(plain_pattern(self.pattern)).findall
        tokens = self.plain(text) if PLAIN.fullmatch(text) else self.split(text)
        return ",".join(map(self.known.__getitem__, tokens))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.spelt.__getitem__, ids.split(","))) if ids else b""


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every whole text; a null text is empty and has no ids.

    ``digest`` returns the SHA-256 of the comma-joined ids and of the decoded bytes in their place.
    The vocabulary, of a size that the file fixes, is built once and sent to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ByteBpe.from_file(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            counts, first, second = [], [], []
            for cell in batch.column(1):
                ids = bpe.encode(cell.as_py() or "")
                back = bpe.decode(ids)
                counts.append(ids.count(",") + 1 if ids else 0)
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digest else [int(x) for x in ids.split(",") if x])
                second.append(hashlib.sha256(back).hexdigest() if digest else back)
            kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])],
                ["id", "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary"))
