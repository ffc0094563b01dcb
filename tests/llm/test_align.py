"""Alignment of two tokenizers against a plain version over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelcast.llm import align

FILES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN]


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [c for c in range(256) if c not in shown]
    back = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(rest)}

    def encode(text):
        """Tokens of the whole text as (id, bytes), by the files' own libraries; None where it has none."""
        if not text:
            return None
        a_tokens = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        b_tokens = []
        for i in b.encode(text, num_threads=1):
            p = b.id_to_piece(i)
            b_tokens.append((i, bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        full = (" " + text).encode()
        if any(b"".join(t for _, t in x) != full for x in (a_tokens, b_tokens)):
            return None
        return a_tokens, b_tokens

    return encode


def ranges(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain(docs, encode):
    """Rows of ``aligned``, by comparing all byte ranges of a text."""
    texts, counts = [], Counter()
    for name, text in docs:
        tokens = encode(text)
        if tokens is None:
            texts.append((name, None))
            continue
        a, b = map(ranges, tokens)
        links, k = [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            m = k
            while m < len(b) and b[m][1] < e:
                links.append((i, b[m][0]))
                m += 1
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        shown, s = [], 0
        for e in ends:
            shown.append("|".join(",".join(str(i) for i, x, y in side if s <= x and y <= e) for side in (a, b)) if len(ends) < 300 else None)
            s = e
        if len(ends) >= 300:
            shown, sides = [], [list(a), list(b)]
            for e in ends:
                both = []
                for side in sides:
                    n = next((k for k, t in enumerate(side) if t[2] > e), len(side))
                    both.append(",".join(str(t[0]) for t in side[:n]))
                    del side[:n]
                shown.append("|".join(both))
        counts.update(links)
        texts.append((name, (len(a), len(b), len(ends), links, hashlib.sha256(";".join(shown).encode()).hexdigest())))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for name, found in texts:
        if found is None:
            out.append((name, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, digest = found
            out.append((name, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def dense(m, columns):
    out = np.zeros((len(m[0]) - 1, columns), dtype=int)
    for i in range(len(out)):
        for c in m[1][m[0][i] : m[0][i + 1]]:
            out[i, c] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6), st.integers(1, 6), st.integers(1, 6))
def test_product_of_sparse_matrices(seed, rows, inner, columns):
    rng = np.random.default_rng(seed)

    def made(n, width):
        cols = [rng.integers(0, width, rng.integers(0, 4)) for _ in range(n)]
        return np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *cols])

    a, b = made(rows, inner), made(inner, columns)
    starts, cols, values = align.product(a, b, columns)
    got = np.zeros((rows, columns), dtype=int)
    for i in range(rows):
        got[i, cols[starts[i] : starts[i + 1]]] = values[starts[i] : starts[i + 1]]
    assert (got == dense(a, inner) @ dense(b, columns)).all()
    assert (dense(align.transposed(a, inner), rows) == dense(a, inner).T).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé \n\t\r\x1c\xa0 _'st9.漢👍▁<|endoftext|>", max_size=30))
def test_segments_are_cut_apart_by_both(text):
    """Ids of the segments laid end to end are those of the whole text."""
    tok = align.tokenizers(*FILES)
    assert tok.apart
    segments = [s for part in tok.segments(text) for s in part]
    assert "".join(segments) == " " + text
    a, b, same = tok.encode(segments)
    hf = Tokenizer.from_file(FILES[0])
    hf.encode_special_tokens = True
    assert [i for x in a for i in x] == hf.encode(" " + text, add_special_tokens=False).ids
    if text:
        whole_b = tok.b.encode(text)
        spelt = b"".join(tok.b_bytes[i] for i in whole_b) == (" " + text).encode()
        assert all(same) == spelt
        if spelt:
            assert [i for x in b for i in x] == whole_b


def odd_docs():
    random.seed(3)
    texts = [None, "", " ", "  ", "\n", "a", "a ", " a", "a  b", "a\n  b", "a \n b", "▁a", "a▁ b", "<|endoftext|> <s> x</s>", "漢字 テスト 👍🏽", "x\x1c y\xa0 z", "é" * 300, "q" * 5000, "\t" * 50 + "x"]
    vocab = ["the", "Theatre", "unbelievably", "naïve", "1234567", "--", "won't", "ß", "don't\nstop"]
    texts += [" ".join(random.choices(vocab, k=random.randrange(1, 80))) for _ in range(60)]
    texts += [texts[30]] * 20
    return list(enumerate(texts)) + [(40, "a second text of one id"), (None, "no id")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_aligned_texts(spark, whole):
    docs = odd_docs()
    table = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in docs], "doc_id long, text string, uid int, block string, key int").repartition(3)
    want = plain(docs, whole)
    assert rows(align.aligned(table, *FILES)) == want
    assert rows(align.aligned(table, *FILES, segments=5)) == want


def test_long_texts_in_parts(spark, whole, monkeypatch):
    """Parts of long texts in several blocks: one row a text, and bad texts leave no counts."""
    docs = odd_docs()
    tok = align.Tokenizers(*FILES)
    monkeypatch.setattr(align, "PART", 7)
    for _, text in docs:
        parts = list(tok.segments(text or ""))
        assert "".join(s for p in parts for s in p) == " " + (text or "")
    # tasks run in other processes, so the stage's function is run here
    from unittest import mock

    caught = {}

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            caught["run"] = run

    align.aligned_blocks(Rows(), *FILES, segments=3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["uid", "id", "text"])
    with mock.patch.object(align, "TaskContext") as context:
        context.get.return_value.partitionId.return_value = 1
        stored = pa.Table.from_batches(list(caught["run"](iter([batch]))))
    blocks = spark.createDataFrame(stored)
    assert blocks.select("block").distinct().count() > 5
    parts = align.scored_texts(blocks, align.pair_counts(blocks))
    got = {}
    for r in parts.collect():
        old = got.get(r["uid"], (r["id"], 0, 0, 0, 0, 0, 0, ""))
        sums = [x + y for x, y in zip(old[1:7], r[2:8], strict=True)]
        got[r["uid"]] = (r["id"], *sums, max(old[7], r["groups_sha256"] or ""))
    assert sorted(got.values(), key=str) == plain(docs, whole)


def test_links_of_texts(spark, whole):
    docs = [(i, t) for i, t in odd_docs() if t and whole(t)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want, shared = [], []
    for name, text in docs:
        a, b = map(ranges, whole(text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        group = [[int(np.searchsorted(ends, e)) for *_, e in side] for side in (a, b)]
        for x, (i, s, e) in enumerate(a):
            for y, (j, t, f) in enumerate(b):
                common = max(0, min(e, f) - max(s, t))
                if common:
                    want.append((name, x, y, i, j, common))
                if group[0][x] == group[1][y]:
                    shared.append((name, x, y, i, j, common))
    assert rows(align.links(table, *FILES)) == sorted(want, key=str)
    assert rows(align.links(table, *FILES, shared_group=True)) == sorted(shared, key=str)


def test_empty_table_and_other_files(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned(none, *FILES).collect() == []
    assert align.links(none, *FILES).collect() == []
    with pytest.raises(ValueError):
        align.Tokenizers(public_tokenizers.path("word_bpe_49k.json"), *FILES[1:])


def test_given_documents(spark, whole):
    from panelcast.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == plain(docs, whole)
