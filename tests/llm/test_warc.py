"""WARC archives: round trip, the records chosen, equal files on every run, and damage."""

from __future__ import annotations

import gzip
import hashlib
import random
import shutil
from pathlib import Path

import pytest

from panelcast.llm import queries, warc

PAGES = "page_id long, url string, html string, uid int, size int, digest string"


def plain(rows):
    """What the archives must say, from the pages alone."""
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and (data not in first or (first[data] is None and page is not None) or (page is not None and page > first[data])):
            first[data] = page
    out, answered = [], set()
    for page, _, html in rows:
        data = (html or "").encode()
        response = data not in first or (page == first[data] and data not in answered)
        if response and data in first:
            answered.add(data)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else first[data]))
    return sorted(out, key=str)


def odd_pages():
    random.seed(5)
    long = "<p>" + "".join(random.choices("abcdé漢 ", k=40_000)) + "</p>"
    rows = [
        (1, "http://a.example/", None), (2, None, ""), (3, "", "x"), (4, "http://a.example/\r\nWARC-Type: x", "y" * 999), (5, "u", "y" * 999),
        (6, "http://é.example/漢 z", "y" * 1000), (7, "u", "y" * 1000), (8, "u", long), (9, "u", long + "!"), (10, "u", "a\r\n\r\nWARC/1.1\r\nb"),
        (None, "n", long), (None, "n", None), (2**62 + 1, "u", "é" * 500), (2**62 + 2, "v", "é" * 501), (12, "u", "é" * 499),
    ]
    rows += [(100 + k, f"http://h.example/{k}", "copy" * 300) for k in range(70)]
    return rows + [(13, "t", "twice" * 400), (13, "t", "twice" * 400), (7, "u", "y" * 1000)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_archives_of_odd_pages(spark, tmp_path):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, 1, 2, "d") for r in rows], PAGES).repartition(4)
    assert rows_of(warc.archived(pages, f"{tmp_path}/a")) == plain(rows)
    back = warc.read_warc(spark, f"{tmp_path}/a").where("type = 'response'")
    want = {}
    for page, _, html in rows:
        want.setdefault((page, hashlib.sha1((html or "").encode()).hexdigest()), (html or "").encode())
    for r in back.collect():
        assert bytes(r["payload"]) == want[r["id"], r["payload_digest"]]
    with pytest.raises(FileExistsError):
        warc.write_warc(pages, f"{tmp_path}/a")


def test_files_follow_from_the_pages_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 8000)
    rows = odd_pages()
    made = []
    for k, parts in enumerate((1, 7)):
        random.Random(k).shuffle(rows)
        folder = f"file://{tmp_path}/{k}"
        manifest = warc.write_warc(spark.createDataFrame([(*r, 1, 2, "d") for r in rows], PAGES).repartition(parts), folder, roll=3000)
        files = {p.name: p.read_bytes() for p in Path(tmp_path, str(k)).glob("*.warc.gz")}
        listed = {r["file"]: r for r in manifest.collect()}
        assert files.keys() == listed.keys() and len(files) > 3
        assert not list(Path(tmp_path, str(k)).glob(".pages*.tmp"))
        for name, data in files.items():
            assert listed[name]["bytes"] == len(data) and listed[name]["sha256"] == hashlib.sha256(data).hexdigest()
            # a file is full with the record that reaches the size
            assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type") >= listed[name]["records"] > 0
        ids = [x for name in sorted(files) for x in (listed[name]["first_id"], listed[name]["last_id"])]
        assert [x or 0 for x in ids] == sorted(x or 0 for x in ids)
        made.append(files)
    assert made[0] == made[1]
    names = sorted(made[0])
    assert len({n[:12] for n in names}) > 3 and any("-0001" in n for n in names)
    for a, b in zip(names, names[1:], strict=False):
        assert a[:12] != b[:12] or len(made[0][a]) >= 3000


def test_records_are_readable_by_their_headers():
    data = warc.record("revisit", 3, "http://x/ \n", "00" * 20, b"", 1234, warc.DATE, (9, None))
    fields, http, payload = warc.parsed(data)
    assert fields["warc-target-uri"] == "http://x/%20%0A" and fields["warc-refers-to-source-id"] == "9" and http["content-length"] == "1234" and payload == b""
    assert fields["warc-refers-to"] == warc.record_id(9, None, "00" * 20, "response")
    with pytest.raises(warc.Corrupt):
        warc.parsed(data[:-6] + b"x" + data[-5:])


def test_damage_and_leftovers(spark, tmp_path):
    rows = [(k, "u", f"{k} " * 900) for k in range(20)]
    folder = f"{tmp_path}/a"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, roll=4000)
    shutil.copy(f"{folder}/pages-000000-0000.warc.gz", f"{folder}/pages-999999-0000.warc.gz")  # in no manifest
    Path(folder, ".pages-000000-0001-x.tmp").write_bytes(b"half")
    assert warc.read_warc(spark, folder).count() == 20
    file = Path(folder, "pages-000000-0000.warc.gz")
    data = file.read_bytes()
    for broken in (data[:-3], data[:200] + bytes([data[200] ^ 8]) + data[201:]):
        file.write_bytes(broken)
        with pytest.raises(Exception, match="Corrupt|error"):
            warc.read_warc(spark, folder).collect()


def test_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none, f"{tmp_path}/a").collect() == []


def test_given_pages(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.op11_warc(spark, sf)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(got) == plain(pages)
