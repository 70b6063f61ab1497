"""WARC archives: a writer, and a sequential reader.

An archive is a row (or a file) of gzip members, one for each record, as the
format asks.  The reader walks an archive front to back: it inflates one
member at a time with an incremental zlib object, frames the record by its
Content-Length, and compares block and payload digests with their headers; a
record that fails is an error, or a row with ``problem`` set.

Records with equal payloads: the one with the smallest page id is the
response, the others are revisits that refer to it and carry no payload.  The
smallest id is aggregated from digests alone; only payloads that occur twice
are in that table, and both sides are salted by page, so that a payload that a
third of all pages share is dealt over many tasks.

Defined results: a null payload is empty; a null page id is a page that comes
after all others (its refers_to is then null); rows that repeat a page id with
one payload are all responses if that id is the smallest; null or odd URLs are
percent-encoded, and left out if empty; other columns are left out; an empty
table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.runtime import settle

#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 8 << 20
#: Parts over which the pages of one payload are dealt.
SALTS = 16
#: Bytes inflated at a time.
STEP = 64 << 10
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    """The same page and payload always get the same record id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def write_record(page: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if target := urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"):
        head.append(f"WARC-Target-URI: {target}")
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to, digest)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + block + END) + packer.flush()


def members(archive: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one at a time; zero bytes between members are padding."""
    view, at = memoryview(archive), 0
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a member")
            piece = view[at : at + STEP]
            at += len(piece)
            parts.append(inflate.decompress(piece))
        at -= len(inflate.unused_data)
        yield b"".join(parts)


def read_record(member: bytes) -> dict:
    """Headers (names in lower case), block and payload of one record, framed and verified."""
    head, found, rest = member.partition(END)
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) < size or rest[size:] != END:
        raise ValueError("the record's length differs from its Content-Length")
    _, _, payload = block.partition(END)
    if headers.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise ValueError("the block's digest differs")
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest") != f"sha1:{base32_sha1(payload)}":
            raise ValueError("the payload's digest differs")
        headers.setdefault("x-payload-length", str(len(payload)))
    return {"headers": headers, "block": block, "payload": payload}


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """archive_id, content (binary): each row a whole .warc.gz of about ARCHIVE_BYTES."""
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    order = F.struct(F.col("page").isNull().alias("last"), F.col("page"))
    seen = rows.filter(F.length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("least")).filter("n > 1")
    repeated = seen.select("digest", F.col("least.page").alias("first"), F.lit(True).alias("again"), F.expr(f"explode(sequence(0, {SALTS - 1})) AS salt"))
    met = rows.withColumn("salt", F.coalesce(F.pmod(F.col("page"), F.lit(SALTS)), F.lit(0)).cast("int")).join(repeated, ["digest", "salt"], "left")
    met = met.select("page", "url", "payload", "first", (F.coalesce("again", F.lit(False)) & ~F.col("page").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        packed = lambda: pa.record_batch({"content": pa.array([b"".join(parts)], pa.binary())})
        for batch in batches:
            for page, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(write_record(page, url, date, payload, first, revisit))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield packed()
                    parts, size = [], 0
        if parts:
            yield packed()

    return met.mapInArrow(run, "content binary").select(F.monotonically_increasing_id().alias("archive_id"), "content")


def save_archives(archives: DataFrame, uri: str) -> int:
    """Write each archive as a file below ``uri`` (any file system of pyarrow that the executors reach); the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name:015d}.warc.gz", compression=None) as out:
                    out.write(content)
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    return archives.select("archive_id", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """The .warc.gz files of a folder that Spark can read, for ``read_archives``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select(F.col("path").alias("archive_id"), "content")


RECORD = "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long, problem string"


def read_archives(archives: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """One row for each record of ``archives`` (column content).

    strict: a record that can't be read or verified is an error; otherwise it
    is a row with only ``problem`` set, and the rest of a damaged member's
    archive is skipped.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        try:
            for member in members(content):
                record = read_record(member)
                h = record["headers"]
                number = lambda name, h=h: int(h[name]) if name in h else None
                yield number("x-page-id"), h["warc-type"], h.get("warc-target-uri"), record["payload"] if payloads else None, number("x-payload-length"), h["warc-payload-digest"].removeprefix("sha1:"), number("x-refers-to-page-id"), None
        except (ValueError, KeyError, zlib.error) as e:
            if strict:
                raise
            yield (*[None] * 7, str(e))

    types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple] = []
                for row in rows(content.as_py() or b""):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held = []
                if held:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return archives.select("content").mapInArrow(run, RECORD)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = settle(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "warc")
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages
), d AS (
  SELECT h, array_to_string(list_transform(range(32), lambda i:
    substr('{BASE32}', CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS digest
  FROM (SELECT DISTINCT h FROM p)
), f AS (SELECT t, min(page_id) AS first FROM p GROUP BY t)
SELECT p.page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d USING (h) JOIN f USING (t)
"""
