"""Main text of web pages: markup zones, and differencing against the page with the nearest URL."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce
from html import unescape
from itertools import islice
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.sized import small_left_join
from panelcast.llm.streams import groups
from panelcast.llm.urls import split_url
from panelcast.session import cut_lineage

#: Pages of a host's path order that one task pairs at a time.
RUN = 4096
#: Steps from a page to pages near it after which copies are told by number; a run brings so many pages more at each end.
REACH = 16
#: A page that shares more than this part of the characters of another is its near copy.
NEAR = 2 / 3

RAW = "script|style|noscript|template|iframe|svg|math|object|textarea|select|title|xmp"
#: Comments, declarations, closed-in-themselves drawings and formulas, elements whose content is never text, and other tags.
TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>|<(?:svg|math)(?=[\s/])(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+(?<=/)>"
    rf"|<({RAW})(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+>(?:.*?</\1\s*+>|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
#: Elements, words of class and id names, and roles that mark what is around an article.
CHROME = frozenset("head nav footer aside form menu dialog button fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer masthead menu modal nav navbar"
    " navigation newsletter notice popup promo related replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: Class words that say what a page has or is about, not what an element is.
ABOUT = re.compile(r"(?:has|no|with|without|tag|category)[-_].+|.+[-_](?:open|closed|enabled|disabled)")

#: Zones of a line.
OPEN, INSIDE, AROUND = 0, 1, 2
#: Zones while a page is read, outside any article: in a main element; around by a part of a class or id word; around by a whole one; an article in such an element.
MAINLY, PARTLY, NAMED, DOUBTED = 3, 4, 5, 6
#: How sure it is that an element is around an article.
PART, WHOLE, SURE = 1, 2, 3


def _chrome(name: str, attributes: str, inside: bool) -> int:
    if name in CHROME or (name == "header" and not inside):
        return SURE
    found = 0
    for key, *values in ATTRIBUTE.findall(attributes) if attributes and name not in ("html", "body") else ():
        said = "".join(values).lower()
        if key.lower() == "role":
            if not CHROME_ROLES.isdisjoint(re.split(r"[^a-z0-9]+", said)):
                return SURE
        elif not CHROME_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", said)):
            for token in said.split():
                if token in CHROME_WORDS:
                    found = WHOLE
                elif not found and not ABOUT.fullmatch(token) and not CHROME_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", token)):
                    found = PART
    return found


def _zone(zone: int, name: str, attributes: str) -> int:
    """Zone inside an element that opens in ``zone``.

    Class and id words never outweigh an article or main element: one in an element that a part of a
    word marks is text, and one that a whole word marks is text if the page has no other.
    """
    if zone == AROUND:
        return AROUND
    chrome = _chrome(name, attributes, zone in (INSIDE, MAINLY, DOUBTED))
    if chrome == SURE or (chrome and zone in (INSIDE, DOUBTED)):
        return AROUND
    if name in MAIN:
        if zone in (NAMED, DOUBTED) or chrome == WHOLE:
            return DOUBTED
        return INSIDE if zone == INSIDE or name == "article" else MAINLY
    if chrome == WHOLE or (chrome and zone == NAMED):
        return NAMED
    return PARTLY if chrome else zone


def _settled(lines: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """``lines`` with one of the three zones each; what was left out by words only comes back where a page has nothing else."""
    zones = {zone for _, zone in lines}
    if zones <= {OPEN, INSIDE, AROUND}:
        return lines
    to = {OPEN: OPEN, INSIDE: INSIDE, AROUND: AROUND, MAINLY: INSIDE, PARTLY: AROUND, NAMED: AROUND, DOUBTED: AROUND}
    if zones.isdisjoint((INSIDE, MAINLY)):
        to[DOUBTED] = INSIDE
        if zones.isdisjoint((OPEN, DOUBTED)):
            to[PARTLY] = OPEN
    return [(text, to[zone]) for text, zone in lines]


def lines_of(html: str) -> list[tuple[str, int]]:
    """(text, zone) of each block in page order; references decoded, white space made one blank, empty blocks left out."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    counts: dict[str, int] = {}
    zone, at = OPEN, 0

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                lines.append((text, zone))
            parts.clear()

    for m in TAG.finditer(html):
        if m.start() > at:
            parts.append(unescape(html[at : m.start()]))
        at = m.end()
        if (name := m[3]) is None:
            if m[1]:
                flush()
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if m[2]:
            if counts.get(name):
                while True:
                    top, before = stack.pop()
                    counts[top] -= 1
                    if before != zone:
                        flush()
                    zone = before
                    if top == name:
                        break
        elif name not in VOID and not m[4].endswith("/"):
            stack.append((name, zone))
            counts[name] = counts.get(name, 0) + 1
            new = _zone(zone, name, m[4])
            if new != zone:
                flush()
            zone = new
    if at < len(html):
        parts.append(unescape(html[at:]))
    flush()
    return _settled(lines)


def undecided(lines: list[tuple[str, int]]) -> list[int]:
    """Indexes of the lines that markup does not decide: those of a page without an article that are not around it."""
    return [] if any(zone == INSIDE for _, zone in lines) else [i for i, (_, zone) in enumerate(lines) if zone == OPEN]


def shared(own: Sequence[int], other: Sequence[int]) -> list[int]:
    """Indexes in ``own`` of a longest common subsequence with ``other``."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    tails: list[int] = []
    ends: list[tuple[int, object]] = []
    for i, h in enumerate(own):
        for j in reversed(places.get(h, ())):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            elif j < tails[k]:
                tails[k], ends[k] = j, link
    out, link = [], ends[-1] if ends else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``: the place in the order of host, path and id, from ranges counted in their own tasks."""
    spark = rows.sparkSession
    dealt = cut_lineage(rows.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id"))
    placed = dealt.withColumn("mono", F.monotonically_increasing_id()).withColumn("part", F.shiftright("mono", 33)).withColumn("local", F.col("mono").bitwiseAND((1 << 33) - 1))
    at, starts = 0, []
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n"]
    before = spark.createDataFrame(starts, "part long, start long")
    return placed.join(F.broadcast(before), "part").withColumn("nth", F.col("start") + F.col("local")).drop("mono", "part", "local", "start")


def _nearest(page: list[dict], i: int) -> Iterator[dict]:
    """The other pages of the host of ``page[i]``, the one with the longest common path first."""
    own, at = page[i], {-1: i, 1: i}
    ahead: dict[int, tuple[int, dict]] = {}

    def step(side: int) -> None:
        at[side] += side
        if 0 <= at[side] < len(page) and (q := page[at[side]])["host"] == own["host"]:
            ahead[side] = (len(commonprefix([own["path"], q["path"]])), q)
        else:
            ahead.pop(side, None)

    step(-1)
    step(1)
    while ahead:
        side = max(ahead, key=lambda k: (ahead[k][0], -k))
        yield ahead[side][1]
        step(side)


def _said(own: dict, other: dict) -> list[int] | None:
    """Places of the lines of ``own`` that ``other`` shares; None if ``other`` is a near copy."""
    found = shared(own["marks"], other["marks"])
    return None if sum(own["sizes"][k] for k in found) > NEAR * sum(own["sizes"]) else [own["places"][k] for k in found]


class Copies:
    """Which pages of a list are near copies of a page; pages with equal lines are compared once."""

    def __init__(self, page: list[dict]) -> None:
        self.page = page
        numbers: dict[tuple, int] = {}
        self.codes = np.array([numbers.setdefault(tuple(q["marks"]), len(numbers)) for q in page], dtype=np.int64)
        hosts = [q["host"] for q in page]
        cuts = [0, *(k for k in range(1, len(page)) if hosts[k] != hosts[k - 1]), len(page)]
        self.spans = {hosts[a]: (a, b) for a, b in zip(cuts, cuts[1:], strict=False)} if page else {}
        self.known: dict[int, np.ndarray] = {}

    def first(self, own: dict, places: range, code: int | None = None) -> int | None:
        """The first of ``places`` (a step of 1 or -1) whose page is no near copy of ``own``; what was found is kept for the pages with its ``code``."""
        copy = np.zeros(len(self.page), dtype=np.int8)  # by code: 1 a copy, 2 none
        if code is not None:
            copy = self.known.setdefault(code, copy)
        at, end = places.start, places.stop
        while at != end:
            codes = self.codes[at:end] if places.step > 0 else self.codes[end + 1 : at + 1][::-1]
            left = copy[codes] != 1
            k = int(left.argmax())
            if not left[k]:
                return None
            at += places.step * k
            if not copy[self.codes[at]]:
                copy[self.codes[at]] = 1 if _said(own, self.page[at]) is None else 2
            if copy[self.codes[at]] == 2:
                return at
        return None


def _beyond(open_pages: DataFrame, placed: DataFrame) -> DataFrame:
    """(leader, side, nth): the first page, from the end of the leader's run on, that is no near copy of it; no row where its host ends before.

    Twice as many runs in every round, each met by the leaders in its own task, so that a host full of copies is spread.
    """
    sides = F.array(*[F.when(F.col(c), F.lit(k)) for c, k in (("on_left", -1), ("on_right", 1))])
    asked = open_pages.select("leader", F.col("own").alias("run"), F.explode(F.array_compact(sides)).alias("side")).distinct()
    lines = placed.select(F.col("nth").alias("leader"), "host", "marks", "sizes", "places")
    asked = cut_lineage(asked.join(lines, "leader"))
    pages = placed.select(F.col("own").alias("block"), "nth", "host", "marks", "sizes", "places", F.lit(0).alias("side"), F.lit(0).cast("long").alias("away"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, page, copies = None, [], None
        for batch in batches:
            out = []
            for q in batch.to_pylist():
                if q["block"] != block:
                    block, page, copies = q["block"], [], None
                if not q["side"]:
                    page.append(q)
                    continue
                copies = copies or Copies(page)
                start, end = copies.spans.get(q["host"], (0, 0))
                at = copies.first(q, range(start, end) if q["side"] > 0 else range(end - 1, start - 1, -1)) if end else None
                if at is not None:
                    out.append((q["nth"], q["side"], q["away"], page[at]["nth"]))
                elif end - start < RUN:
                    out.append((q["nth"], q["side"], q["away"], None))  # the host ends here
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["leader", "side", "away", "nth"])

    parts, first = [], 1
    while not asked.isEmpty():
        away = F.sequence(F.lit(first).cast("long"), F.lit(2 * first - 1).cast("long"))
        sent = asked.withColumn("away", F.explode(away)).withColumn("block", F.col("run") + F.col("side") * F.col("away"))
        met = pages.unionByName(sent.select("block", F.col("leader").alias("nth"), "host", "marks", "sizes", "places", "side", "away"))
        met = met.repartition("block").sortWithinPartitions("block", F.col("side") != 0, "nth")
        told = met.mapInArrow(look, "leader long, side int, away long, nth long").groupBy("leader", "side").agg(F.min_by("nth", "away").alias("nth"))
        parts.append(cut_lineage(told))
        asked = cut_lineage(asked.join(parts[-1].select("leader", "side"), ["leader", "side"], "left_anti"))
        first *= 2
    return reduce(DataFrame.unionByName, parts).where("nth is not null")


def _far(open_pages: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, drops) of pages whose nearest page may lie beyond the run they are in."""
    found = cut_lineage(_beyond(open_pages, placed))
    for side, name in ((-1, "left"), (1, "right")):
        there = found.where(F.col("side") == side).select("leader", F.col("nth").alias("_far"), F.lit(True).alias(f"on_{name}"))
        open_pages = open_pages.join(there, ["leader", f"on_{name}"], "left").withColumn(name, F.coalesce(name, "_far")).drop("_far")
        other = placed.select(F.col("nth").alias(name), F.struct("path", "marks").alias(f"{name}_page"))
        open_pages = open_pages.join(other, name, "left")
    rows = open_pages.select("nth", "left_page", "right_page").join(placed.select("nth", "id", "path", "places", "marks", "sizes"), "nth")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, drops = [], []
            for p in batch.to_pylist():
                near = [q for q in (p["left_page"], p["right_page"]) if q]
                if near and (said := _said(p, max(near, key=lambda q: len(commonprefix([p["path"], q["path"]]))))):
                    names.append(p["id"])
                    drops.append(said)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(drops, pa.list_(pa.int32()))], ["id", "drops"])

    return rows.select("id", "path", "places", "marks", "sizes", "left_page", "right_page").mapInArrow(decide, "id long, drops array<int>")


def shared_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, drops): for pages with undecided lines, the line indexes shared with the page of the nearest URL.

    Pages are laid out by host and path in runs of RUN pages with REACH pages more at each end, so
    that a host with most of the pages is spread. On each side the nearest page has the longest common
    path. A near copy, which shares more than NEAR of the characters of a page, says nothing about it:
    the next nearest page is taken, however far; pages whose run ends before are looked for in the
    runs beyond. A page with near copies only on its host loses no line.
    """
    host, path = split_url(F.col(url_col))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, marks, sizes = [], [], []
            for cell in batch.column("html"):
                lines = lines_of(cell.as_py() or "")
                at = undecided(lines)
                where.append(at)
                marks.append([xxhash.xxh3_64_intdigest(lines[i][0].encode("utf-8", "surrogatepass")) >> 1 for i in at])
                sizes.append([len(lines[i][0]) for i in at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(where, pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))], ["id", "host", "path", "places", "marks", "sizes"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    parsed = rows.mapInArrow(parse, "id long, host string, path string, places array<int>, marks array<long>, sizes array<int>").where(F.size("marks") > 0)
    placed = _ordered(parsed).withColumn("own", F.floor(F.col("nth") / RUN))
    runs = F.array_distinct(F.array("own", F.floor((F.col("nth") - REACH) / RUN), F.floor((F.col("nth") + REACH) / RUN)))
    dealt = placed.withColumn("run", F.explode(runs)).where("run >= 0").repartition("run").sortWithinPartitions("run", "nth")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["run"]):
            page = group.to_pylist()
            copies, leaders, out = None, {}, []

            def far(i: int) -> list[int] | tuple | None:
                """What the nearest page says, or the nearest ones so far and the sides to look on."""
                p, code = page[i], int(copies.codes[i])
                start, end = copies.spans[p["host"]]
                at = [copies.first(p, range(i - 1, start - 1, -1), code), copies.first(p, range(i + 1, end), code)]
                alike = [-1 if k is None else len(commonprefix([p["path"], page[k]["path"]])) for k in at]
                most = [len(commonprefix([p["path"], page[k]["path"]])) for k in (start, end - 1)]
                on_left = at[0] is None and start == 0 and page[0]["nth"] > 0 and most[0] >= alike[1]
                on_right = at[1] is None and end == len(page) and most[1] > alike[0]
                if on_left or on_right:
                    return (leaders.setdefault((code, p["host"]), p["nth"]), *(None if k is None else page[k]["nth"] for k in at), on_left, on_right)
                return None if at == [None, None] else _said(p, page[at[0] if alike[0] >= alike[1] else at[1]])

            for i, p in enumerate(page):
                if p["own"] != p["run"]:
                    continue
                said, steps = None, 0
                for other in islice(_nearest(page, i), REACH):
                    steps += 1
                    if (said := _said(p, other)) is not None:
                        break
                if said is None and steps == REACH:
                    copies = copies or Copies(page)
                    said = far(i)
                if isinstance(said, tuple):
                    out.append((p["id"], None, p["nth"], p["own"], *said))
                elif said:
                    out.append((p["id"], said, *[None] * 7))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["id", "drops", "nth", "own", "leader", "left", "right", "on_left", "on_right"]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 5, *[pa.bool_()] * 2]
    near = cut_lineage(dealt.mapInArrow(pair, "id long, drops array<int>, nth long, own long, leader long, left long, right long, on_left boolean, on_right boolean"))
    open_pages = near.where("leader is not null").drop("id", "drops")
    near = near.where("leader is null").select("id", "drops")
    return near if open_pages.isEmpty() else near.unionByName(_far(open_pages, placed))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): main text of every page.

    Markup decides first: lines inside an article or main element are text, lines in menus, footers
    and the like never are. On pages without such an element the remaining lines are compared with
    the page of the nearest URL on the host that is no near copy, and shared lines go. A null or empty page gives an empty
    text. Ids name pages: rows with one id and different pages share their deletions.
    """
    drops = cut_lineage(shared_lines(pages, id_col, url_col, html_col).groupBy("id").agg(F.first("drops").alias("drops"))).withColumnRenamed("id", "_id")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    joined = small_left_join(rows, drops, F.col("page_id") == F.col("_id"), F.size("drops")).select("page_id", "url", "html", "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for cell, gone in zip(batch.column("html"), batch.column("drops"), strict=True):
                lines = lines_of(cell.as_py() or "")
                left = set(undecided(lines)) - set(gone.as_py() or ())
                texts.append(" ".join(text for i, (text, zone) in enumerate(lines) if zone == INSIDE or i in left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
