"""Text operators against brute force: language ID, SimHash, packing, BPE, lines, repeats."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from panelcast.llm import bpe, language, lines, packing, queries, repeats, simhash
from panelcast.llm.graph import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, None) for i, t in enumerate(texts)], DOCS)


def prose(rng, words):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    long = prose(rng, 30_000)
    same = prose(rng, 80)
    return [None, "", " ", "1234 --", "a", "two words", same, same, same.upper(), "日本語 テキスト 👍🏽 é", "é x\x1c y", "a" * 5000, long, long[:20_000] + "x" + long[20_000:], "line\n\nline\nline"]


# graph


def test_components_of_loops_repeats_and_chains(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 9), (8, 7), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 5 SimHash


def slow_fingerprint(text, words=3, seed=42):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, radius):
    """Least id reachable for each id, over all pairs."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_all_pairs(spark, odd_texts):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows |= {1000 + i: t for i, t in enumerate(odd_texts)}
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows.items()], "doc_id long, text string, fp string")
    got = {r["id"]: r for r in simhash.simhash_groups(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r["component"] for i, r in got.items()} == slow_groups(fps, 2)


@pytest.mark.parametrize("radius", [0, 2, 9])
def test_tiles_find_all_near_fingerprints(spark, radius):
    rng = random.Random(radius)
    fps = {}
    for i in range(400):
        base = rng.getrandbits(64) if i % 3 or not fps else rng.choice(list(fps.values()))
        for b in rng.sample(range(64), rng.randint(0, radius + 1)):
            base ^= 1 << b
        fps[i] = base
    fps = {i: f for f, i in {f: i for i, f in fps.items()}.items()}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f, []) for i, f in fps.items()], "id long, fp long, more array<long>")
    edges = simhash.near_edges(df, radius, radius, tile=16)
    comp = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {i: comp.get(i, i) for i in fps} == slow_groups(fps, radius)


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_groups(docs_of(spark, [])).count() == 0
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def test_keep_one_finds_near_copies_and_keeps_the_rest(spark):
    rng = random.Random(3)
    words = [prose(rng, 300).split() for _ in range(60)]
    texts = [" ".join(w) for w in words]
    for w in words[:20]:
        w = list(w)
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, [*texts, texts[5]])).collect()}
    assert kept == set(range(60))


def near_copy(words, shared, rng):
    """A text with ``shared`` of the five-word shingles of ``words``, the rest of its words new."""
    return " ".join([*words[: shared + 4], *(f"new{rng.getrandbits(60)}" for _ in range(len(words) - shared - 4))])


@pytest.mark.parametrize("percent", [70, 79, 80, 85])
def test_keep_one_decides_by_the_similarity_of_the_texts(spark, percent):
    """Of 2 * 1790 shingles in each pair of texts a share is common that gives the named similarity, or just misses it."""
    rng = random.Random(percent)
    n, texts = 1790, []
    shared = -(-2 * n * percent // (100 + percent))  # common / (2 n - common) >= percent / 100
    for _ in range(30):
        w = [f"w{rng.getrandbits(60)}" for _ in range(n + 4)]
        texts += [" ".join(w), near_copy(w, shared, rng)]
    sets = [simhash.shingle_set(t) for t in texts]
    same = [np.isin(a, b).sum() / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert all(percent / 100 <= x < percent / 100 + 0.001 for x in same)
    kept = {r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(range(0, 60, 2) if percent >= 80 else range(60))


def test_keep_one_decides_every_pair_that_may_join_groups(spark):
    """A chain: neighbours are at 0.9, texts further off below 0.8, all of them near by their bits."""
    rng = random.Random(11)
    w = [f"w{rng.getrandbits(60)}" for _ in range(400)]
    texts = [" ".join(w[k : k + 300]) for k in range(0, 90, 15)]
    apart = [" ".join(w[k : k + 300]) for k in range(0, 100, 50)]
    assert [r["doc_id"] for r in simhash.keep_one(docs_of(spark, texts)).collect()] == [0]
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, apart)).collect()} == {0, 1}
    short = ["a b c d e f g h i", "a b c d e f g h", "a b c d e f g", None, ""]
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(spark, short)).collect()} == {0, 2, 3}


# 4 language ID


def test_ppm_costs_match_a_plain_recursion(spark):
    model = language.learn(docs_of(spark, ["the cat sat", "on the mat"]).union(docs_of(spark, ["der hund und die katze"], lang="de")))
    assert model.langs == ["de", "en"]
    counts = {x: dict(zip(map(int, g), map(int, c), strict=True)) for x, g, c in zip(model.langs, model.grams, model.counts, strict=True)}

    def cost(lang, gram, order):
        if order < 0:
            return np.log2(language.CLASSES)
        tail = gram % language.CLASSES ** (order + 1)
        seen = Counter()
        for g, n in counts[lang].items():
            if g % language.CLASSES ** (order + 1) // language.CLASSES == tail // language.CLASSES:
                seen[g % language.CLASSES] += n
        if not seen:
            return cost(lang, gram, order - 1)
        total = sum(seen.values()) + len(seen)
        return -np.log2(seen[gram % language.CLASSES] / total) if gram % language.CLASSES in seen else -np.log2(len(seen) / total) + cost(lang, gram, order - 1)

    for text in (b"the und", b"zzz", "käse\x00".encode()):
        want = [sum(cost(x, int(g), language.ORDER) for g in language.grams_of(text, model.classes)) for x in model.langs]
        assert np.allclose(model.bits(text), want, atol=len(text) / language.UNIT)


def test_every_byte_keeps_its_symbol(spark):
    """Two languages that differ in rare letters only, beside a sample rich in other bytes."""
    letters = [chr(0x100 + k) for k in range(60)] + [chr(c) for c in range(33, 127)]
    plain = ["".join(random.Random(i).choices(letters, k=400)) for i in range(20)]
    first = docs_of(spark, [*plain, "Q\u0411 " * 3], lang="one")
    model = language.learn(first.union(docs_of(spark, [*plain, "Q\u0412 " * 3], lang="two")))
    assert len(set(model.classes.tolist())) == language.CLASSES == 256
    assert [model.predict(t)[0] for t in ("\u0411 \u0411", "\u0412 \u0412")] == ["one", "two"]
    everything = bytes(range(256)) * 3
    assert np.array_equal(language.grams_of(everything, model.classes)[3:], [int.from_bytes(everything[i : i + 4], "big") for i in range(len(everything) - 3)])


def test_chunks_do_not_change_a_code_length(spark, monkeypatch):
    model = language.learn(docs_of(spark, ["one two three four", "five six"]))
    text = ("seven eight nine " * 50).encode()
    whole = model.bits(text)
    monkeypatch.setattr(language, "STEP", 7)
    assert np.array_equal(model.bits(text), whole)


def test_language_of_odd_texts(spark, odd_texts):
    model = language.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = [r for r in language.identify(docs_of(spark, odd_texts), model).orderBy("id").collect()]
    assert [r["lang_pred"] for r in got[:4]] == ["und"] * 4 and all(r["score"] == 0 for r in got[:4])
    assert all(r["lang_pred"] in model.langs and 0 <= r["score"] <= 1 for r in got[4:])
    nothing = language.learn(docs_of(spark, [None, ""]))
    assert nothing.langs == [] and language.identify(docs_of(spark, ["text"]), nothing).first()["lang_pred"] == "und"
    assert language.identify(docs_of(spark, []), model).count() == 0
    assert {r["doc_id"] for r in language.keep_identified(docs_of(spark, odd_texts), model).collect()} == set(range(4, len(odd_texts)))


def test_held_out_accuracy_and_split(spark):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


# 6 packing


def test_pieces_match_the_tokenizer(spark, odd_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    got = defaultdict(list)
    for r in packing.pieces(docs_of(spark, odd_texts), path).orderBy("id", "piece").collect():
        got[r["id"]].append(r)
    for i, t in enumerate(odd_texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for r in got[i] for x in r["ids"]] == ids
        assert [r["start"] for r in got[i]] == list(range(0, len(ids), 4096))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got[i])


def test_new_words_are_merged_without_the_whole_tokenizer(monkeypatch):
    """A word not met yet took a whole call of the tokenizer, which normalises and splits it again."""
    encoder = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Words not met: rendblean, antionston d'Être ÀÖß 12.5", "'s''t </w> <|endoftext|>", "".join(map(chr, [*range(32, 127), *range(0xF8, 0x100)]))]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.tokenizer = encoder.known.tokenizer = None
    assert [encoder.encode(t).tolist() for t in texts] == want
    monkeypatch.setattr(packing, "REMEMBERED", 2)
    encoder.known.clear()
    assert [encoder.encode(t).tolist() for t in texts] == want


@pytest.mark.parametrize("seed", range(6))
def test_fill_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    cap = [7, 64, 4096][seed % 3]
    counts = {int(k): int(n) for k, n in zip(rng.integers(1, cap + 1, 300), rng.integers(1, 50, 300), strict=True)}
    bins = packing.fill(counts, cap)
    used = Counter()
    for lengths, n in bins:
        assert sum(lengths) <= cap
        for x in lengths:
            used[x] += n
    assert dict(used) == counts
    assert sum(n for _, n in bins) >= -(-sum(k * n for k, n in counts.items()) // cap)


def test_fill_takes_exact_complements():
    assert sum(n for _, n in packing.fill({4096: 3, 4000: 2, 96: 2, 3000: 1, 1000: 1, 90: 1, 6: 1}, 4096)) == 6
    assert packing.fill({}, 4096) == []


def test_sequences_are_gapless(spark, odd_texts):
    texts = [*odd_texts, *(["same words here"] * 40)]
    rows = packing.packed_documents(docs_of(spark, texts), public_tokenizers.path("word_bpe_49k.json")).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.packed_documents(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 7 byte-level BPE


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.order) == list(range(3000)) and [h.find(k) for k in keys] == list(range(3000)) and h.find(b"none") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1


def test_bpe_matches_the_library(spark, odd_texts):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    every = "".join(chr(c) + "a \n"[c % 3] for c in range(1, 0x2100))
    texts = [*odd_texts, every, "it's 't're", "<|endoftext|>"]
    full = {r["id"]: r for r in bpe.encoded(docs_of(spark, texts), path, public_tokenizers.PATTERN).collect()}
    short = {r["id"]: r for r in bpe.encoded(docs_of(spark, texts), path, public_tokenizers.PATTERN, digest=True).collect()}
    for i, t in enumerate(texts):
        ids = want.encode_ordinary(t or "")
        assert full[i]["ids"] == ids and full[i]["decoded"] == (t or "").encode() and full[i]["n_tokens"] == len(ids)
        assert short[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


# 8 line dedup


def test_lines_of_small_null_and_clashing_sites(spark):
    rows = [(i, f"menu\nown {i}\n\nown {i}", "big") for i in range(20)] + [(50 + i, "menu\ntext", "small") for i in range(3)] + [(90 + i, "menu" if i else None, None) for i in range(12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, site string, n_lines int")
    got = {r[0]: r for r in lines.drop_boilerplate(df.drop("n_lines")).select("doc_id", "text", "n_lines", "n_dropped", "site").collect()}
    assert got[3]["text"] == "own 3\n\nown 3" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 1)
    assert got[51]["text"] == "menu\ntext" and got[51]["n_dropped"] == 0
    assert got[90]["text"] is None and got[90]["n_lines"] == 0 and got[91]["text"] == "" and len(got) == len(rows)
    assert lines.drop_boilerplate(df.drop("n_lines").limit(0)).count() == 0


# 2 repeated strings


def slow_removal(texts, length):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeats_case(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (20, 30, 45, 60)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, len(parts)), p[cut:])
        texts.append(" ".join(parts))
    base = prose(rng, 150)
    for _ in range(25):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice("xyz") + base[at + 1 :])
    return [*texts, texts[0], texts[0], "ab" * 700, "c" * 900, "", "short", passages[3], "é" * 150 + passages[2]]


@pytest.mark.parametrize("limit", [4096, 6])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, monkeypatch, seed, limit):
    """Small limits send classes through the block and window rounds."""
    monkeypatch.setattr(repeats, "CLASS", limit)
    texts = repeats_case(seed)
    found = repeats.with_spans(docs_of(spark, [*texts, None]), length=200, limit=limit).collect()
    want = slow_removal([t.encode() for t in texts] + [b""], 200)
    for r in found:
        runs = repeats.removed(len(r["_text"]), r["_n"], r["_spans"])
        got = (len(r["_text"]), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(repeats.kept(bytes(r["_text"]), runs)).hexdigest())
        assert got == want[r["doc_id"]], r["doc_id"]


def test_repeat_digests_and_texts(spark):
    texts = repeats_case(5)
    df = docs_of(spark, [*texts, None])
    want = slow_removal([t.encode() for t in texts] + [b""], 200)
    got = {r["doc_id"]: r for r in repeats.digests(df).collect()}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == dict(enumerate(want))
    left = {r["doc_id"]: r for r in repeats.without_repeats(df.withColumnRenamed("n_chars", "_n2")).collect()}
    assert left[len(texts)]["text"] is None and len(left) == len(want)
    assert all("�" not in (r["text"] or "") for r in left.values())
    assert repeats.digests(docs_of(spark, [])).count() == 0


def test_samples_across_chunks(monkeypatch):
    text = prose(random.Random(4), 900).encode() + b"z" * 700
    whole = repeats.samples(text)
    monkeypatch.setattr(repeats, "STEP", 97)
    repeats._powers.cache_clear()
    parts = repeats.samples(text)
    repeats._powers.cache_clear()
    covered = [i for a, low, high in zip(*(x.tolist() for x in parts[:3]), strict=True) for i in range(a - high, a - low + 1)]
    assert covered == list(range(len(text) - 199))
    assert all(np.array_equal(x, y) for x, y in zip(whole[:3], parts[:3], strict=True))
