"""The pipeline and each of its stages against plain Python, and columns whose names clash with those used inside."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from panelcast.llm import html, language, lines, packing, repeats, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def words(rng, n):
    return [rng.choice(["the", "river", "garden", "stone", "quiet", "morning", "letter", "window"]) + str(rng.randrange(400)) for _ in range(n)]


def changed(rng, text, share):
    found = text.split(" ")
    for k in rng.sample(range(len(found)), round(share * len(found))):
        found[k] = f"other{rng.randrange(10**6)}"
    return " ".join(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randrange(60, 160))) for _ in range(60)]
    texts += [changed(rng, texts[0], 0.01) for _ in range(5)] + [texts[1]] * 4 + [None, "", "123 %%", "漢字ばかりの文", "x"]
    passage = " ".join(words(rng, 45))
    texts += [" ".join(words(rng, 50)) + "\n" + passage + "\n" + " ".join(words(rng, 50)) for _ in range(3)]
    out = []
    for k, text in enumerate(texts):
        site = f"s{k % 2}"
        if text and k % 3 == 0 and k < 60:
            text = "Subscribe now\n" + text
        out.append((k, text, "en" if k % 5 and text != "漢字ばかりの文" else None, site, len(text or "")))
    return out


# ---- plain stages ----


def plain_language(docs):
    return [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]


def plain_lines(docs):
    pages = Counter(d[3] for d in docs)
    seen = Counter((d[3], x) for d in docs if d[1] is not None for x in {v.strip(" ") for v in d[1].split("\n")} if x)
    gone = {k for k, n in seen.items() if pages[k[0]] >= 10 and n / pages[k[0]] > 0.1}
    return [(d[0], None if d[1] is None else "\n".join(x for x in d[1].split("\n") if (d[3], x.strip(" ")) not in gone), *d[2:]) for d in docs]


def shingled(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def plain_near(docs):
    sets = {}
    for d in docs:
        sets.setdefault(d[0], []).append(shingled(d[1]))
    group = {k: k for k in sets}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any((not x and not y) or (x and y and 5 * len(x & y) >= 4 * len(x | y)) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return [d for d in docs if top(d[0]) == d[0]]


def plain_repeats(docs, size=200):
    starts = Counter(t[i : i + size] for d in docs for t in [(d[1] or "").encode()] for i in range(len(t) - size + 1))
    out = []
    for d in docs:
        t = (d[1] or "").encode()
        keep = bytearray(b"\1" * len(t))
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                keep[i : i + size] = bytes(size)
        out.append((d[0], None if d[1] is None else bytes(b for b, k in zip(t, keep) if k).decode(), *d[2:]))
    return out


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("name, plain", [("language_id", plain_language), ("line_dedup", plain_lines), ("near_duplicates", plain_near), ("repeated_strings", plain_repeats)])
def test_stage(spark, table, rows, name, plain):
    got = STAGES[name](spark, table, "")
    assert got.columns == table.columns
    assert collected(got) == sorted(plain(rows), key=str)
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= corpus_pipeline.BATCH


def test_whole_pipeline(spark, table, rows, tmp_path):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    left = rows
    for stage in (plain_language, plain_lines, plain_near, plain_repeats):
        left = stage(left)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for d in left:
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 1]
        want[d[0]] = (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == want
    filled = Counter()
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= packing.CAPACITY and len(filled) == -(-sum(filled.values()) // packing.CAPACITY)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_reject_no_text(spark, rows):
    table = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in rows], DOCS)
    kept = STAGES["language_id"](spark, table, "")
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])}


# ---- near duplicates ----


def test_similarities_on_both_sides(spark):
    """Families that are near by their bits but below the limit stay whole, and give no rows but their members."""
    rng = random.Random(2)
    core = words(rng, 300)
    texts = []
    for _ in range(150):  # a common core of 72 % of the shingles: similarity 0.56
        texts.append(" ".join(core[:216] + words(rng, 84)))
    base = " ".join(words(rng, 400))
    found = base.split(" ")
    for cut in (88, 80, 70):  # the last words are others': similarity (396 - cut) / (396 + cut), 0.64 to 0.70
        texts.append(" ".join(found[:-cut] + words(rng, cut)))
    for cut in (40, 20, 4):  # 0.82 and above
        texts.append(" ".join(found[:-cut] + words(rng, cut)))
    texts.append(base)
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    got = collected(simhash.keep_one(spark.createDataFrame(rows, DOCS)))
    assert got == sorted(plain_near(rows), key=str)


def test_blocks_of_a_family(spark):
    rng = random.Random(4)
    base = " ".join(words(rng, 200))
    texts = [changed(rng, base, 0.01 * rng.randrange(1, 4)) for _ in range(40)] + [" ".join(words(rng, 200)) for _ in range(10)]
    members = [(0, k, 0, [0, 0, 0], simhash.shingle_set(t).tobytes()) for k, t in enumerate(texts)]
    table = spark.createDataFrame([(f, k, fp, more, bytearray(s)) for f, k, fp, more, s in members], "family long, id long, fp long, more array<long>, shingles binary")
    from panelcast.llm.graph import components

    want = plain_near([(k, t) for k, t in enumerate(texts)])
    for size in (5000, 1 << 22):
        edges = simhash.alike_edges(table, 64, 256, size)
        assert edges.count() < 20 * len(texts)
        comp = {r["node"]: r["component"] for r in components(edges).collect()}
        assert sorted(k for k in range(len(texts)) if comp.get(k, k) == k) == [k for k, _ in want]


def test_texts_of_one_id(spark):
    rng = random.Random(6)
    a, b = (" ".join(words(rng, 100)) for _ in range(2))
    rows = [(1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, changed(rng, b, 0.01), "en", "s", 0), (0, changed(rng, a, 0.01), "en", "s", 0), (None, a, "en", "s", 0)]
    got = collected(simhash.keep_one(spark.createDataFrame(rows, DOCS)))
    assert [r[0] for r in got] == [0, None]


# ---- names ----

CLASHES = ["h1", "h2", "h", "fp", "n", "_n", "_text", "_spans", "_null", "id", "mean", "sd", "n_lines", "n_dropped", "_kept", "_marks", "_site", "site", "marks", "family", "_gone", "text_", "c0", "c1"]


def test_clashing_columns(spark):
    rng = random.Random(9)
    long = " ".join(words(rng, 60))
    rows = [(k, long if k < 3 else " ".join(words(rng, 30)), "en", "s", 5, *range(len(CLASHES))) for k in range(12)]
    schema = DOCS + "".join(f", `{c}` long" for c in CLASHES)
    table = spark.createDataFrame(rows, schema)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        got = STAGES[name](spark, table, "")
        assert got.columns == table.columns and got.count() > 0
        assert {tuple(r[5:]) for r in got.collect()} == {tuple(range(len(CLASHES)))}
    assert len(STAGES["best_fit_packing"](spark, table, "").collect()) == 12
    counted = lines.drop_boilerplate(table)
    assert counted.columns == [c for c in table.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert repeats.digests(table).count() == 12 and repeats.without_repeats(table).count() == 12
    pages = spark.createDataFrame([(k, f"http://h{k}.example/{k}", "<p>x</p>", *range(len(CLASHES))) for k in range(4)], "page_id long, url string, html string" + "".join(f", `{c}` long" for c in CLASHES))
    judged = urls.judge(pages, spark.createDataFrame([("http://h1.example/1", 1)], "url string, good int"))
    assert judged.columns == [*pages.columns, "host", "path", "rule", "verdict", "good_mean", "good_bound"] and judged.count() == 4
    assert html.extract(pages.select("page_id", "url", "html")).count() == 4
    assert language.identify(table, language.learn(table)).count() == 12
