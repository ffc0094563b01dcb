"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.session import cut_lineage

#: Labelled rows a language is learned from at most, taken in the order of a hash of the id.
ROWS_PER_LANGUAGE = 2000
#: Parts in which the first rows of a language are looked for.
PARTS = 64
#: Symbols: every byte is its own.
CLASSES = 256
#: Length of the longest context.
ORDER = 3
#: Code lengths are kept in units of 1/512 bit.
UNIT = 512
#: Bytes scored at a time.
STEP = 1 << 20
LETTER = regex.compile(r"\p{L}")


@dataclass
class PpmModel:
    """Frozen context trees of all languages: for each language the sorted longest contexts with their symbol, and their counts.

    Tables hold what was seen in the sample only, so the sample bounds them and not the alphabet.
    """

    langs: list[str]
    classes: np.ndarray
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    table: tuple[np.ndarray, np.ndarray, list] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def costs(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Sorted (ORDER + 1)-grams of any language, the code lengths of their last byte in one row for all languages, and the trees."""
        if self.table is None:
            trees = []
            for grams, counts in zip(self.grams, self.counts, strict=True):
                levels = []
                for order in range(ORDER + 1):
                    keys, where = np.unique(grams.astype(np.int64) % CLASSES ** (order + 1), return_inverse=True)
                    n = np.bincount(where, counts.astype(np.float64))
                    contexts, at = np.unique(keys // CLASSES, return_inverse=True)
                    t, d = np.bincount(at, n), np.bincount(at)
                    levels.append((keys.astype(np.uint32), -np.log2(n / (t + d)[at]), contexts.astype(np.uint32), -np.log2(d / (t + d))))
                trees.append(levels)
            seen = np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *(levels[-1][0] for levels in trees)]))
            self.table = seen, rows_of(seen, trees), trees
        return self.table

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of a whole text under each language."""
        total = np.zeros(len(self.langs), dtype=np.int64)
        seen, table, trees = self.costs()
        for at in range(0, len(text), STEP):
            codes = grams_of(text, self.classes, at, at + STEP)
            place = np.searchsorted(seen, codes)
            place[place == len(seen)] = 0
            known = seen[place] == codes
            place = place[known]
            for k in range(table.shape[1]):
                part = np.take(table[:, k], place).view(np.int16).reshape(-1, 4)
                own = slice(4 * k, min(4 * k + 4, len(self.langs)))
                total[own] += part.sum(axis=0, dtype=np.int64)[: own.stop - own.start]
            if len(place) < len(codes):
                new, n = np.unique(codes[~known], return_counts=True)
                total += n @ rows_of(new, trees).view(np.int16)[:, : len(self.langs)].astype(np.int64)
        return total / UNIT

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior under equal priors); ``und`` and 0 for a text without letters."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        bits = self.bits(text.encode("utf-8", "surrogatepass"))
        best = int(np.argmin(bits))
        return self.langs[best], float(1.0 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``asked`` in the sorted ``keys``, and whether each is there."""
    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return place, keys[place] == asked


def rows_of(codes: np.ndarray, trees: list) -> np.ndarray:
    """Code length of the last byte of each (ORDER + 1)-gram, in one row for all languages, four to a number.

    A context that was seen codes a known symbol with n / (t + d) and escapes to the next shorter
    context with d / (t + d): t symbols and d distinct ones were seen in it. A context never seen
    hands over at no cost; below the empty context all bytes are equally likely.
    """
    rows = np.full((len(codes), -(-len(trees) // 4) * 4), 32767, dtype=np.int16)
    for i, levels in enumerate(trees):
        cost = np.full(len(codes), np.log2(CLASSES))
        for order, (keys, known, contexts, escape) in enumerate(levels):
            tails = (codes.astype(np.int64) % CLASSES ** (order + 1)).astype(np.uint32)
            place, there = _find(contexts, tails // np.uint32(CLASSES))
            cost += np.where(there, escape[place], 0.0)
            place, there = _find(keys, tails)
            cost = np.where(there, known[place], cost)
        rows[:, i] = np.minimum(cost * UNIT, 32767)
    return rows.view(np.int64)


def grams_of(text: bytes, classes: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Codes of the (ORDER + 1)-grams that end at bytes ``start`` to ``stop``; blanks stand before the text."""
    stop = len(text) if stop is None else min(stop, len(text))
    lead = max(0, ORDER - start)
    b = np.frombuffer(b" " * lead + text[max(0, start - ORDER) : stop], dtype=np.uint8)
    c = classes[b].astype(np.uint32)
    n = stop - start
    code = c[:n].copy()
    for k in range(1, ORDER + 1):
        code *= CLASSES
        code += c[k : k + n]
    return code


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> PpmModel:
    """Context trees from at most ``rows`` whole texts of each language (null and empty ones are left out).

    The sample is the ids with the least hash, so it does not depend on how the rows are dealt (rows of one id count each by itself); a table
    without labels gives a model without languages. The texts are counted on the executors. The driver gets, per language, the distinct (ORDER + 1)-grams
    of the sample and their counts.
    """
    spark = docs.sparkSession
    good = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    good = good.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    # the first of each part of a language, then of what is left: no task orders a whole language
    least = [F.xxhash64("id"), F.col("id")]
    part = Window.partitionBy("lang", "part").orderBy(*least)
    ids = good.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)).alias("part"))
    ids = ids.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= rows)
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*least))).where(F.col("nth") <= rows)
    chosen = cut_lineage(ids.select("id").distinct())
    sample = cut_lineage(good.join(F.broadcast(chosen), "id", "left_semi").select("lang", F.encode("text", "UTF-8").alias("text")))

    classes = np.arange(CLASSES, dtype=np.uint8)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).append(grams_of(cell.as_py(), classes))
            for lang, found in by.items():
                keys, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    got = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, grams, counts = (got.column(k).to_numpy(zero_copy_only=False) for k in range(3))
    langs: Sequence[str] = sorted(set(names.tolist()))
    return PpmModel(list(langs), classes, [grams[names == x] for x in langs], [counts[names == x] for x in langs])


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text; ``und`` with score 0 where it is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            said = [ppm.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], ["id", "lang_pred", "score"])
        ppm.table = None  # a worker that goes on to other tasks doesn't keep it

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def keep_identified(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is ``und``: null texts and texts without letters.

    A model without languages (nothing was labelled) can't name one, and rejects by the letters alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identified(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ppm = shared.value
        for texts in parts:
            if ppm.langs:
                yield pd.Series([ppm.predict(t)[0] != "und" for t in texts], dtype=bool)
            else:
                yield pd.Series([bool(t) and LETTER.search(t) is not None for t in texts], dtype=bool)
        ppm.table = None

    return docs.where(F.pandas_udf(identified, "boolean")(F.col(text_col).cast("string")))
