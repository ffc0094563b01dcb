"""Vector and page operators against brute force: neighbours, near vectors, URL filters, HTML text."""

from __future__ import annotations

import math
import random
import re
from difflib import SequenceMatcher
from html import unescape

import numpy as np
import pytest

from panelcast.llm import html, lsh, neighbors, queries, urls
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
BAD = [None, [], [0.0, 0.0, 0.0, 0.0], [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0]]


def vector_rows(seed=0, n=300, dim=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.uniform(0.5, 2, (n, 1))
    x[50:60] = x[50]
    x[70:90] = x[70] * rng.uniform(0.9, 1.1, (20, dim))
    return [(i, v.tolist()) for i, v in enumerate(x)]


# 1 neighbours


def slow_nearest(rows, asked, k):
    out = {}
    good = {i: v for i, v in rows}
    for q in asked:
        scored = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_all_neighbours_are_found_when_the_search_is_certain(spark):
    rows = vector_rows()
    df = spark.createDataFrame([*rows, *((1000 + i, v) for i, v in enumerate(BAD)), (2000, [1.0, 2.0]), rows[7]], "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as id")
    got = {}
    for r in neighbors.nearest(df, df.where("vec_id % 20 = 0"), k=7, projected=2, confidence=1 - 1e-12).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    want = slow_nearest(rows, range(0, 300, 20), 7)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [r["rank"] for r in found] == list(range(1, 8))
        assert [r["id"] for r in found] == [i for i, _ in want[q]]
        assert np.allclose([r["score"] for r in found], [s for _, s in want[q]], rtol=1e-12)


def test_neighbours_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["id"], r["score"]) for r in neighbors.nearest(df, df.where("vec_id = 0"), k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, 0.0)]
    assert neighbors.nearest(df.limit(0), df).count() == 0
    assert neighbors.nearest(df, df.where("false")).count() == 0


def test_recall_of_the_registered_query(spark):
    got = queries.op1_nearest_neighbors(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = slow_nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert len(got) == sum(map(len, want.values())) and hits / len(got) >= 0.9


def test_kd_tree_and_chi_square():
    points = np.random.default_rng(1).standard_normal((500, 3))
    points[100:200] = points[100]
    tree = neighbors.KdTree(points, 16)
    leaf = tree.leaf(points)
    assert len(set(leaf[100:200].tolist())) == 1 and leaf.max() < tree.leaves <= 16
    assert neighbors.KdTree(np.ones((50, 2)), 8).leaves == 1
    assert math.isclose(neighbors.chi_square(0.95, 8), 15.507313, rel_tol=1e-6) and math.isclose(neighbors.chi_square(0.99, 2), 9.210340, rel_tol=1e-6)


# 3 near vectors


def slow_links(rows, threshold):
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in np.flatnonzero(near[i])) for i in range(len(rows))]
    return {rows[i][0]: (int(near[i].sum()) - 1, rows[root[i]][0]) for i in range(len(rows))}


@pytest.mark.parametrize("tile", [2048, 5])
def test_links_match_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(lsh.near_links, "__defaults__", (*lsh.near_links.__defaults__[:-1], tile))
    rows = vector_rows(2, dim=12)
    rows += [(400 + i, (np.array(rows[i][1]) * 3).tolist()) for i in range(5)]
    extra = [(1000 + i, v) for i, v in enumerate(BAD)] + [(2000, [1.0, 2.0])]
    df = spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<double>").selectExpr("*", "1 as n_links", "2 as rep")
    got = {r["id"]: r for r in lsh.near_vectors(df, recall=1 - 1e-9).collect()}
    assert {i: (got[i]["n_links"], got[i]["component_id"]) for i, _ in rows} == slow_links(rows, 0.9)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i, _ in extra)
    assert len(got) == len(rows) + len(extra)


def test_near_vectors_of_an_empty_table(spark):
    assert lsh.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_table_plan_keeps_the_recall():
    for n in (10, 1000, 10**6, 10**9):
        k, tables = lsh.plan_tables(n, 0.9)
        assert 1 - (1 - lsh.collision(math.sqrt(0.2)) ** k) ** tables >= lsh.RECALL
        assert n * lsh.collision(math.sqrt(2)) ** k <= max(lsh.OCCUPANCY, n * lsh.collision(math.sqrt(2)) ** 4)


# 9 URL filters


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def slow_rule(host, path):
    fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_odd_urls(spark):
    odd = [
        None, "", "no scheme", "http://", "http://com/", "http://COM/x", "http://notcom/", "ftp://WWW.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com/en",
        "http://m.example.com/en/1", "x://net/es/", "x://a.net/fr/://b.com/", "http://a.net?x=/es/", "http://ÄÖ.Net/de/", "http://a.net\n/es/", "http://a.org" + "/x" * 20_000, "http://u:p@a.com:80/en/",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*odd, *odd])], "page_id long, url string, rule string")
    got = urls.judge(pages, spark.createDataFrame([], "url string, good int")).collect()
    assert len(got) == 2 * len(odd)
    for r in got:
        host, path = slow_url(r["url"])
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("allow" if r["good_bound"] >= urls.MIN_GOOD else "block"))
    assert urls.judge(pages.limit(0), spark.createDataFrame([], "url string, good int")).count() == 0


def test_reputation_shrinks_small_hosts_to_their_domain(spark):
    pages = [(i, f"http://h{i % 4}.{'good' if i % 4 < 2 else 'bad'}.org/{i}") for i in range(400)] + [(900, "http://new.good.org/1"), (901, "http://new.bad.org/1"), (902, "http://tiny.good.org/1")]
    labels = [(u, 1 if "good" in u else 0) for i, u in pages[:300]] + [("http://tiny.good.org/1", 0)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "url string, good int")).collect()}
    assert [got[i]["verdict"] for i in (0, 2)] == ["allow", "block"]
    assert got[900]["good_mean"] > 0.6 > 0.4 > got[901]["good_mean"]
    assert got[0]["good_mean"] > got[902]["good_mean"] > got[2]["good_mean"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_registered_queries_match_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE[name]) == ""


# 10 HTML text


def test_articles_of_the_given_pages(spark):
    got = {r["page_id"]: r for r in html.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", inside).replace("<b>", "").replace("</b>", "")).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_markup_zones():
    page = (
        "<!DOCTYPE html><html class=menu><head><title>T</title></head><body class='nav'><header>H</header><main><header><h1>A &amp; B</h1></header><!-- <p>no -->"
        "<p>one<b>two</b>\n  three<br>four&nbsp;five<p>six <span class='x advert'>no</span>seven<script>'</p>'</script><form>no</form><ul><li>eight</ul>"
        "<div id=user-comments>no<p>no</div>a < b</main><aside>no</aside>tail<div role='contentinfo'>no</div><style>no"
    )
    text = [t for t, zone in html.lines_of(page) if zone == html.INSIDE]
    assert text == ["A & B", "onetwo three", "four five", "six", "seven", "eight", "a < b"]
    assert html.lines_of("") == [] and html.lines_of("<p") == [("<p", html.OPEN)] and html.lines_of("&am; &#65;")[0][0] == "&am; A"
    assert html.lines_of("<b>" * 50_000 + "x" + "</i></b>" * 50_000) == [("x", html.OPEN)]
    assert html.lines_of("<a '" * 20_000)


def test_custom_and_closed_elements_are_no_raw_text():
    page = "<svg-icon></svg-icon><p>one</p><title-bar>two</title-bar><select-menu><p>three</p></select-menu><svg viewBox='0 0 1 1'/><p>four</p><math/><svg><text>no</text></svg><p>five</p><script/>no"
    assert [t for t, _ in html.lines_of(page)] == ["one", "two", "three", "four", "five"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='layout has-sidebar'><p>text</p></div>", ["text"]),
        ("<div class='layout has-sidebar'><article>text</article><aside>no</aside></div>", ["text"]),
        ("<article class='post comments-open'>text</article>", ["text"]),
        ("<article class='tag-cookies'>text</article>", ["text"]),
        ("<div class='page-sidebar-layout'>no<article>text</article></div>", ["text"]),
        ("<div id=social><main>text</main>no</div>", ["text"]),
        ("<main class=widget><p>text<div class=comments>no</div></main>", ["text"]),
        ("<article>text</article><div class=comments><article class=comment>no</article></div>", ["text"]),
        ("<article>text<div class=comments><article class=comment>no</article></div></article>", ["text"]),
        ("<main><article class='post comments-open'>text</article><div class='related'><article>no</article></div></main>", ["text"]),
        ("<nav><article>no</article></nav>text<div class=ad>no</div>", ["text"]),
        ("<div class=site-wrap-widget>text</div>", ["text"]),
    ],
)
def test_class_words_do_not_outweigh_articles(page, want):
    lines = html.lines_of(page)
    left = html.undecided(lines)
    assert [t for i, (t, zone) in enumerate(lines) if zone == html.INSIDE or i in left] == want


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html.shared(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        assert sum(m.size for m in SequenceMatcher(None, [a[i] for i in got], b, autojunk=False).get_matching_blocks()) <= len(got)


def test_pages_without_articles_lose_shared_lines(spark):
    pages = [(i, f"http://H.org/a/{i:04d}", f"<div>Site menu</div><p>own text {i}</p><p>again</p><p>more {i}</p><div>All rights</div>") for i in range(9000)]
    pages += [(9500, "http://h.org/b/1", "<p>same"), (9501, "http://h.org/b/2", "<p>same"), (9502, None, None), (9503, "", ""), (9504, "http://other.org/", "<div>Site menu</div>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert all(got[i] == f"own text {i} more {i}" for i in range(9000))
    assert [got[i] for i in range(9500, 9505)] == ["same", "same", "", "", "Site menu"]
    assert html.extract(df.limit(0)).count() == 0


def test_near_copies_do_not_delete_each_other(spark):
    """Two copies that differ in one line, alone on a host and beside other pages of it."""
    body = "".join(f"<p>a line of the article, number {k}" for k in range(8))
    pages = [(0, "http://a.org/x/1", f"{body}<p>version one"), (1, "http://a.org/x/2", f"{body}<p>version two")]
    pages += [(2, "http://b.org/x/1", f"<p>Site menu{body}<p>version one"), (3, "http://b.org/x/2", f"<p>Site menu{body}<p>version two")]
    pages += [(4, "http://b.org/y/1", "<p>Site menu<p>another text, which is its own"), (5, "http://b.org/z/1", "<p>Site menu<p>a third text with other words")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    article = " ".join(f"a line of the article, number {k}" for k in range(8))
    for i in (0, 2):
        assert [got[i], got[i + 1]] == [f"{article} version one", f"{article} version two"]
    assert [got[4], got[5]] == ["another text, which is its own", "a third text with other words"]


def test_nearest_pages_by_common_path():
    page = [{"host": "h", "path": x} for x in ("/a", "/b/1", "/b/1/x", "/b/1/y", "/c")] + [{"host": "i", "path": "/c"}]
    assert [q["path"] for q in html._nearest(page, 2)] == ["/b/1/y", "/b/1", "/a", "/c"]


def test_near_copies_do_not_hide_the_page_behind_them(spark):
    """Sixty copies on one host, the only other page at the end of its paths."""
    body = "".join(f"<p>a line of the article, number {k}" for k in range(8))
    pages = [(k, f"http://a.org/x/{k:03d}", f"<p>Site menu{body}<p>version {k}") for k in range(60)]
    pages.append((60, "http://a.org/y", "<p>Site menu<p>another text, which is its own"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert not any("Site menu" in text for text in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_pages_beyond_their_run(spark, monkeypatch, seed):
    """Short runs: the search in and beyond them finds what a walk over the whole host finds."""
    monkeypatch.setattr(html, "RUN", 8)
    monkeypatch.setattr(html, "REACH", 2)
    rng = random.Random(seed)
    pages = []
    for k in range(300):
        host, kind = rng.choice(["a.org", "b.org", "b.org", "b.org"]), rng.choice([0] * 30 + [1])
        own = f"<p>note {rng.randrange(3)}"
        lines = [f"<p>line {kind} {j} with some more words" for j in range(6)] if kind == 0 else [f"<p>line 0 {rng.randrange(6)} with some more words", f"<p>long text that only page {k} has, with many words of its own"]
        pages.append((k, f"http://{host}/{rng.choice('xyz')}/{rng.randrange(400):03d}", "".join(lines) + own))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    parsed = []
    for k, url, text in pages:
        host, path = url[7:].split("/", 1)
        lines = [t for t, _ in html.lines_of(text)]
        parsed.append({"id": k, "host": host, "path": "/" + path, "marks": lines, "sizes": [len(t) for t in lines], "places": list(range(len(lines)))})
    parsed.sort(key=lambda p: (p["host"], p["path"], p["id"]))
    want = {}
    for i, p in enumerate(parsed):
        said = next((x for x in (html._said(p, q) for q in html._nearest(parsed, i)) if x is not None), None)
        if said:
            want[p["id"]] = said
    got = {r["id"]: r["drops"] for r in html.shared_lines(df).collect()}
    assert got == want and len(want) > 30
