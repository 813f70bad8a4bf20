"""Legacy archive converter: ARC archives of versions 1 and 2 to WARC records, written and read through Spark.

An ARC archive begins with a version block that names the fields of all later header lines; each record is a header
line, as many bytes as the line declares, and a line break.  A converted record gets an identifier, a timestamp, a
type and digests.  Bodies are bytes and need not be text.  Each record is one gzip member, as readers of such archives
expect.  Members go to files through Spark's text sink, so any store that Spark can write will do: the sink writes the
bytes of a string as they are, and the line end that it adds is the zero byte that ends a member of under 16 MiB (behind
a longer one it is padding, which gzip allows).  Archives and files are bounded by bytes, not by records; a larger page
has one for itself.  Files are read back one at a time and their members one by one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from uuid import UUID

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import fresh_path, table

#: The field lists of the two header line versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
CRLF = b"\r\n"
#: Bytes of pages in one archive, after which the next begins, and archives in one file.
ARCHIVE_BYTES, ARCHIVES_PER_FILE = 1 << 19, 128
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uuid(page_id: int | None, digest: str) -> str:
    """A version 8 UUID that holds the page's number (66 bits of room) and six bytes of the digest; null: all ones."""
    n = (1 << 65) if page_id is None else page_id & ((1 << 64) - 1)
    head = int.from_bytes(hashlib.sha1(digest.encode()).digest()[:6], "big")
    return str(UUID(int=head << 80 | 8 << 76 | (n >> 62) << 64 | 2 << 62 | n & ((1 << 62) - 1)))


def uuid_page(text: str) -> int | None:
    """The page number within an identifier of ``record_uuid``."""
    i = UUID(text).int
    n = (i >> 64 & 0xFFF) << 62 | i & ((1 << 62) - 1)
    return None if n >> 65 else n - (1 << 64) if n >> 63 else n


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def write_arc(version: int, records: list[tuple[str, bytes]], name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    """An archive of (url, whole HTTP response) records."""
    intro = b"%d 0 crawl\n%s\n" % (version, " ".join(FIELDS[version]).encode())

    def line(url: str, kind: str, body: bytes) -> bytes:
        url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
        more = ["200", "-", "-", "0", name] if version == 2 else []
        return " ".join([url, "0.0.0.0", date, kind, *more, str(len(body))]).encode() + b"\n" + body + b"\n"

    return line(f"filedesc://{name}", "text/plain", intro) + b"".join(line(u, "text/html", b) for u, b in records)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record, the version block first.

    A header line is read from its right end, so a URL may hold spaces.  ValueError: an unknown version, a header
    line with too few fields, a length that isn't a number or goes beyond the archive.
    """
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # line breaks between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("header line without an end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = line.rpartition(" ")[2]
        if not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"declared length {length!r} of {line[:80]!r}")
        body = data[end + 1 : end + 1 + int(length)]
        if fields is None:
            version = body.split(b" ", 1)[0].strip()
            if version not in (b"1", b"2"):
                raise ValueError(f"version {version[:20]!r}")
            fields = FIELDS[int(version)]
        values = line.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in {line[:80]!r}")
        yield dict(zip(fields, values)), body
        at = end + 1 + int(length)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers (with their closing empty line) and payload; no headers if the block isn't HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def warc_record(head: dict[str, str], body: bytes, page_id: int | None, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record for an ARC record, without the separator behind it.

    The version block becomes a warcinfo record, an HTTP response a response or (without payload) a revisit record,
    anything else a resource record.
    """
    d = head["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    http, payload = split_http(body)
    digest = base32_sha1(payload)
    info = head["URL"].startswith("filedesc:")
    kind = "warcinfo" if info else "resource" if not http else "revisit" if revisit else "response"
    block = http if kind == "revisit" else body
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_uuid(page_id, digest)}>", f"WARC-Date: {date}"]
    if info:
        lines += ["Content-Type: application/warc-fields", f"WARC-Filename: {head['URL'].removeprefix('filedesc://')}"]
        block = b"software: archive converter\r\nformat: WARC file version 1.1\r\n"
    else:
        kind_of = "application/http;msgtype=response" if http else head["Content-type"]
        lines += [f"WARC-Target-URI: {head['URL']}", f"WARC-IP-Address: {head['IP-address']}", f"Content-Type: {kind_of}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_uuid(refers_to, digest)}>"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return CRLF.join(x.encode() for x in lines) + CRLF + CRLF + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with lower-case names, block) of each record, cut by declared lengths.  ValueError if torn."""
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, n = end + 4, int(head["content-length"])
        if data[start + n : start + n + 4] != CRLF + CRLF:
            raise ValueError(f"record at byte {at} doesn't end where it declares")
        yield head, data[start : start + n]
        at = start + n + 4


def pages_to_arcs(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, page_ids, refers_to, revisit) for rows (page_id, url, html, refers_to, revisit); versions alternate.

    An archive ends when it holds ``archive_bytes`` of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for b in batches:
            size = np.cumsum([len(h) for h in b.column(2).to_pylist()])
            at = 0
            while at < b.num_rows:
                before = size[at - 1] if at else 0
                n = max(1, int(np.searchsorted(size, before + archive_bytes)) - at)
                ids, urls, html, refers, revisit = (c.to_pylist() for c in b.slice(at, n).columns)
                data = write_arc(version, [(u or "", http_block(h)) for u, h in zip(urls, html)])
                version, at = 3 - version, at + n
                cols = [pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([refers], pa.list_(pa.int64())), pa.array([revisit], pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, ["archive", "page_ids", "refers_to", "revisit"])

    return pages.mapInArrow(run, "archive binary, page_ids array<long>, refers_to array<long>, revisit array<boolean>")


def gzip_member(record: bytes) -> bytes:
    """A record with its separator as one gzip member, without a time, so that equal records give equal bytes."""
    return gzip.compress(record + CRLF + CRLF, 3, mtime=0)


def gzip_members(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file one by one; zero bytes between them are padding."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        one = zlib.decompressobj(31)
        out = one.decompress(memoryview(data)[at:])
        if not one.eof:
            raise ValueError(f"torn gzip member at byte {at}")
        at = len(data) - len(one.unused_data)
        yield out


def arcs_to_warc(arcs: DataFrame) -> DataFrame:
    """(value): the WARC records of each archive as gzip members, for rows of ``pages_to_arcs``.  Records keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, *lists in zip(*(c.to_pylist() for c in b.columns)):
                notes = [(None, None, False), *zip(*lists)]
                members = b"".join(gzip_member(warc_record(head, body, *note)) for (head, body), note in zip(read_arc(data), notes))
                yield pa.RecordBatch.from_arrays([pa.array([members.removesuffix(b"\0")], pa.binary())], ["value"])

    return arcs.mapInArrow(run, "value binary")


def write_warc(records: DataFrame, path: str, per_file: int = ARCHIVES_PER_FILE) -> None:
    """Write archives of gzip members to files of at most ``per_file`` archives each."""
    raw = records.select(F.col("value").cast("string").alias("value"))  # bytes stay as they are
    raw.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """RECORD_SCHEMA of all records but warcinfo in the files of a folder; digests of blocks and payloads are checked.

    ``payload`` is null for revisits; their ``payload_bytes`` is what their HTTP headers declare.
    """
    bare = lambda x: x.removeprefix("<urn:uuid:").removesuffix(">") if x else None
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary()]

    def row(head: dict[str, str], block: bytes) -> tuple:
        if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError(f"block digest of {head['warc-record-id']}")
        http, payload = split_http(block)
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            n, payload = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1]), None
        elif digest != base32_sha1(payload):
            raise ValueError(f"payload digest of {head['warc-record-id']}")
        else:
            n = len(payload)
        return bare(head["warc-record-id"]), head["warc-type"], head["warc-target-uri"], head["warc-date"], bare(head.get("warc-refers-to")), digest, n, payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows, size = [], 0
                for member in gzip_members(data.as_py()):
                    for head, block in read_warc(member):
                        if head["warc-type"] != "warcinfo":
                            rows.append(row(head, block))
                            size += len(block)
                    if size > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html as bytes, refers_to, revisit): of equal payloads of ``least`` bytes or more the largest page_id stays.

    ``html`` may be text or bytes of any kind.  Null html counts as empty; very long ones are kept whole.  All rows of the largest page_id are responses, if it is repeated.  Rows without a
    page_id refer to it too, and are responses if no equal payload has one.
    """
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    digests = named.where(F.octet_length("html") >= least).select("page_id", F.sha1("html").alias("digest"))
    largest = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = digests.join(largest, "digest").where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    mine = named.withColumn("digest", F.sha1("html")).alias("p")
    joined = mine.join(again.alias("a"), F.expr("p.page_id <=> a.page_id and p.digest = a.digest"), "left")
    return joined.select("p.page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))


def archive_pages(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write all pages as WARC records by way of ARC archives."""
    write_warc(arcs_to_warc(pages_to_arcs(with_revisits(pages, least))), path)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back.  An empty table gives no rows; columns beyond page_id, url and html are not read."""
    path = fresh_path(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    return page_rows(read_warc_files(spark, path))


def page_rows(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that ``archive_pages`` wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, refers = ([None if x is None else uuid_page(x) for x in b.column(i).to_pylist()] for i in (0, 4))
            cols = [pa.array(ids, pa.int64()), b.column(1), b.column(2), b.column(3), pa.array(refers, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    picked = records.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return picked.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Base32 by the digest's 160 bits, five at a time.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), b AS (
  SELECT *, (unhex(sha1(payload))::BIT)::VARCHAR AS bits, max(page_id) OVER (PARTITION BY payload) AS largest FROM p
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: (16 >> j) * substr(bits, 5 * i + j + 1, 1)::INTEGER))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM b
"""
