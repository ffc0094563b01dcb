"""Deterministic, sharded WARC archives of pages, and their reader."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.hot import hot_join
from panelcast.operators.ordering import ranged_totals
from panelcast.session import cut_lineage, scratch_path

#: Compressed bytes after which the next record opens a new file.
ROLL = 64 << 20
#: Payload bytes that one task writes, and the most shards there may be: beyond, they become larger.
SHARD, SHARDS = 16 << 20, 100_000
#: Bytes a record's headers count for.
HEADERS = 600
#: Payloads of this many bytes are stored once; later equal ones only refer to the response.
REVISIT = 1000
#: Date of every record unless another is given: archives of equal pages are equal byte for byte.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read from an archive at a time.
CHUNK = 1 << 20

#: A record as it is read.
READ = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("id", pa.int64()), ("url", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])
NAMES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {NAMES[f.type]}" for f in schema)


# records


def clean_url(url: str | None) -> str | None:
    """A URL that fits a header line: control characters and blanks are percent-encoded; an empty one is none."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None


def record_id(page: int | None, url: str | None, digest: str, kind: str) -> str:
    """A name that follows from what the record holds."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page, url, digest, kind]))}>"


def record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, length: int, date: str, refers: tuple[int | None, str | None] | None = None) -> bytes:
    """One WARC/1.1 record. ``length`` is that of the full payload, which a revisit doesn't hold; ``digest`` its SHA-1 in hex."""
    url = clean_url(url)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id(page, url, digest, kind)), ("WARC-Date", date), ("WARC-Target-URI", url),
        ("WARC-Source-ID", page), ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + b32encode(hashlib.sha1(block).digest()).decode()),
    ]
    if refers is not None:
        first, its_url = refers[0], clean_url(refers[1])
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, its_url, digest, "response")),
                   ("WARC-Refers-To-Target-URI", its_url), ("WARC-Refers-To-Source-ID", first)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_keys(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, digest, html): pages with their payload in bytes and its SHA-1 in hex."""
    html = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha1(html).alias("digest"), html.alias("html"))


def decisions(keyed: DataFrame, smallest: int) -> DataFrame:
    """(id, url, digest, n, copies, full, to_id, to_url): one row for each distinct page, how many of its copies are responses, and the response that
    the others revisit: of equal payloads of ``smallest`` bytes or more, the page with the largest id (then URL)."""
    light = cut_lineage(keyed.groupBy("id", "url", "digest", F.length("html").alias("n")).agg(F.count("*").alias("copies")))
    best = light.where(F.col("n") >= smallest).groupBy("digest").agg(F.max(F.struct("id", "url")).alias("first"), F.count("*").alias("rows"), F.sum("copies").alias("all")).where("all > 1")
    found = hot_join(light, best, "digest", "rows", light.count(), "left")
    own = F.col("id").eqNullSafe(F.col("first.id")) & F.col("url").eqNullSafe(F.col("first.url"))
    full = F.when(F.col("first").isNull(), F.col("copies")).otherwise(own.cast("long"))
    return found.select("id", "url", "digest", "n", "copies", full.alias("full"), F.col("first.id").alias("to_id"), F.col("first.url").alias("to_url"))


def _ranked(page: int | None, url: str | None, digest: str) -> tuple:
    """A page's place in the order of Spark: nulls first, strings by their bytes."""
    return (page is not None, page or 0, url is not None, (url or "").encode("utf-8", "surrogatepass"), digest)


# files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as the session names it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _commit(system: fs.FileSystem, temporary: str, final: str) -> None:
    """Gives a finished file its name; a file of that name is another attempt's and equal."""
    if system.type_name == "local" or system.get_file_info(final).type == fs.FileType.NotFound:
        system.move(temporary, final)
    else:
        system.delete_file(temporary)


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    roll: int = ROLL, date: str = DATE, smallest: int = REVISIT,
) -> DataFrame:
    """Archives ``pages`` below ``folder`` (a new path that all executors reach) and returns the manifest: (file, records, bytes, sha256, first_id, last_id).

    Every page is one record, a gzip member of its own. Distinct pages are range-sorted by id, URL and digest; a running
    total of payload bytes over that order cuts it into shards of about SHARD bytes (more where there would be over
    SHARDS of them). One task writes a shard, in order, and opens a new file every ``roll`` compressed bytes. Files
    therefore follow from the pages alone, not from partitions, executors or retries. Headers and digests are made
    anew from the payload. A file is written under a temporary name and renamed when it is whole; the manifest is written
    last and renamed too, and readers open only files that it names. What a lost executor leaves
    behind is never read, and its second attempt writes the same bytes.

    The payloads are shuffled once, to their shards; all else works on keys. Null html is an empty payload, a null or empty
    URL no header. Rows that are equal in all three are written as often as they are there; the one with the largest id, then
    URL, is the response of equal payloads of ``smallest`` bytes. No pages give an empty manifest. Other columns don't matter.
    """
    spark = pages.sparkSession
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    if system.get_file_info(f"{base}/manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive")
    keyed = page_keys(pages, id_col, url_col, html_col)
    weight = F.col("full") * F.col("n") + F.col("copies") * HEADERS
    light = decisions(keyed, smallest).withColumn("weight", weight)
    order = [F.asc_nulls_first("id"), F.asc_nulls_first("url"), F.asc("digest")]
    placed = cut_lineage(ranged_totals(light, [], order, F.col("weight"), "end"))
    size = max(SHARD, -(-(placed.agg(F.max("end").alias("n")).first()["n"] or 0) // SHARDS))
    placed = placed.withColumn("shard", F.floor((F.col("end") - F.col("weight")) / size))
    # one row a shard, at most SHARDS + 1
    firsts = sorted((_ranked(*r["k"]), r["shard"]) for r in placed.groupBy("shard").agg(F.min(F.struct("id", "url", "digest")).alias("k")).collect())
    shared = spark.sparkContext.broadcast(([k for k, _ in firsts], [n for _, n in firsts]))

    def shard_of(ids: pd.Series, urls: pd.Series, digests: pd.Series) -> pd.Series:
        keys, numbers = shared.value
        at = [bisect_right(keys, _ranked(None if i is None else int(i), u, d)) - 1 for i, u, d in zip(ids, urls, digests, strict=True)]
        return pd.Series([numbers[k] for k in at], dtype="int64")

    bodies = keyed.select(F.pandas_udf(shard_of, "long")(F.col("id").cast("string"), "url", "digest").alias("shard"), "id", "url", "digest", F.lit(1).alias("kind"), "html")
    rows = bodies.unionByName(placed.select("shard", "id", "url", "digest", F.lit(0).alias("kind"), "full", "to_id", "to_url"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        now, number, out, temporary, seen = None, 0, None, "", []
        key, left, to = None, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, number
            if out is None:
                return
            out.close()
            name = f"pages-{now:06d}-{number:04d}.warc.gz"
            _commit(system, temporary, f"{base}/{name}")
            out, number = None, number + 1
            yield pa.RecordBatch.from_pylist([{"file": name, "records": seen[0], "bytes": seen[1], "sha256": seen[2].hexdigest(), "first_id": seen[3], "last_id": seen[4]}], schema=manifest)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a batch holds whole pages: few payloads at a time
                part = batch.slice(at, 64)
                for shard, page, url, digest, kind, html, full, to_id, to_url in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if kind == 0:
                        key, left, to = (page, url, digest), full, (to_id, to_url)
                        continue
                    if key != (page, url, digest):
                        raise Corrupt(f"page {page} has no place: the pages changed while they were read")
                    if shard != now or (out is not None and seen[1] >= roll):
                        yield from close()
                        number = 0 if shard != now else number
                        now = shard
                    if out is None:
                        temporary = f"{base}/.pages-{now:06d}-{number:04d}-{uuid.uuid4().hex}.tmp"
                        out, seen = system.open_output_stream(temporary, compression=None), [0, 0, hashlib.sha256(), page, page]
                    again = hashlib.sha1(html).hexdigest()
                    data = member(record("response", page, url, again, html, len(html), date) if left else record("revisit", page, url, again, b"", len(html), date, to))
                    left = max(0, left - 1)
                    out.write(data)
                    seen[2].update(data)
                    seen[0], seen[1], seen[4] = seen[0] + 1, seen[1] + len(data), page
        yield from close()

    manifest = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * len(firsts))
    files = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "id", "url", "digest", "kind").mapInArrow(run, ddl(manifest))
    draft = f"{folder.rstrip('/')}/manifest-{uuid.uuid4().hex}.tmp"
    files.write.parquet(draft)
    system.move(_place(draft)[1], f"{base}/manifest")
    return spark.read.schema(ddl(manifest)).parquet(f"{folder.rstrip('/')}/manifest")


# reading


class Corrupt(ValueError):
    """An archive that isn't what its manifest or headers say."""


def _members(stream: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream, one at a time."""
    unpack, parts, start, at, data = zlib.decompressobj(31), [], 0, 0, b""
    while True:
        if not data and not (data := stream.read(CHUNK)):
            break
        at += len(data)
        parts.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            data = unpack.unused_data
            at -= len(data)
            yield start, b"".join(parts)
            unpack, parts, start = zlib.decompressobj(31), [], at
    if at != start:
        raise Corrupt("an archive ends inside a record")


def parsed(content: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record, names in lower case; digests and lengths must hold."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *given = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in given)}
    length = int(fields["content-length"])
    block = rest[:length]
    if not version.startswith("WARC/1.") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise Corrupt("a record has another length than its header says")
    if fields["warc-block-digest"] != "sha1:" + b32encode(hashlib.sha1(block).digest()).decode():
        raise Corrupt(f"the block of {fields['warc-record-id']} has another digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}, payload


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """READ columns of every record of the archives that the manifest of ``folder`` names; payload is null for revisits and without ``payloads``.

    One task reads a file as a stream and holds one record. A response's digest and length are taken again
    from its payload; a difference from the headers, or a file of another size than the manifest's, raises ``Corrupt``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        for batch in batches:
            for file, records, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out, held, n = [], 0, 0
                if system.get_file_info(f"{base}/{file}").size != size:
                    raise Corrupt(f"{file} has another size than the manifest says")
                with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for offset, content in _members(stream):
                        fields, http, payload = parsed(content)
                        digest, length = b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex(), int(http["content-length"])
                        full = fields["warc-type"] == "response"
                        if full and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                            raise Corrupt(f"the payload of {fields['warc-record-id']} has another digest")
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        out.append({
                            "file": file, "offset": offset, "record_id": fields["warc-record-id"], "type": fields["warc-type"], "id": number("warc-source-id"),
                            "url": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest,
                            "refers_to": number("warc-refers-to-source-id"), "payload": payload if full and payloads else None,
                        })
                        held, n = held + len(payload), n + 1
                        if held > CHUNK or len(out) >= 1000:
                            yield pa.RecordBatch.from_pylist(out, schema=READ)
                            out, held = [], 0
                if n != records:
                    raise Corrupt(f"{file} has {n} records in place of {records}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=READ)

    named = spark.read.parquet(f"{folder.rstrip('/')}/manifest").select("file", "records", "bytes")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return named.repartition(files, "file").mapInArrow(run, ddl(READ))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from archives of ``pages``."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    write_warc(pages, folder)
    back = read_warc(pages.sparkSession, folder, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
