import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from tidemill.llm import warc


def slow(rows):
    same = defaultdict(list)
    for i, _, html in rows:
        same[html or ""].append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = max((x for x in same[html or ""] if x is not None), default=None)
        again = best is not None and i != best
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(map(str, out))


def round_trip(spark, frame, tmp_path):
    warc.archive_pages(frame, str(tmp_path / "w"))
    return sorted(str(tuple(r)) for r in warc.page_rows(warc.read_warc_files(spark, str(tmp_path / "w"))).collect())


def test_pages(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(str(tuple(r)) for r in warc.op10(spark, sf).collect()) == slow(rows)


def test_odd_pages(spark, tmp_path):
    rows = [
        (1, "http://a/ b\n", "x"), (2, None, "x"), (3, "", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (-7, "é", "é\0🎉"),
        (9, "v", "\n\n"), (2**62, "big", "x"), (-(2**63), "min", "y"), (None, "w", "y"), (None, "w", "z"), (6, "a", "t" * 300000), (6, "a", "t" * 300000),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    assert round_trip(spark, frame, tmp_path) == slow(rows)


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"), tmp_path) == []


def test_bodies_need_not_be_text(spark, tmp_path):
    jpeg = bytes.fromhex("ffd8ffe000104a46494600010100") + bytes(range(256)) * 40
    long = hashlib.sha256(b"x").digest() * (20 << 15)  # 20 MiB: its gzip member doesn't end with a zero byte
    rows = [(1, "a", jpeg), (2, "b", jpeg), (3, "c", long), (4, "d", b"\xff\x00\r\n"), (5, "e", b"")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1)
    warc.archive_pages(frame, str(tmp_path / "w"))
    got = warc.read_warc_files(spark, str(tmp_path / "w"))
    assert {warc.uuid_page(r.record_id): r.payload and bytes(r.payload) for r in got.where("record_type = 'response'").collect()} == {2: jpeg, 3: long, 4: b"\xff\x00\r\n", 5: b""}
    (back,) = warc.page_rows(got).where("record_type = 'revisit'").collect()
    assert (back.page_id, back.payload_bytes, back.refers_to) == (1, len(jpeg), 2)


def test_one_gzip_member_a_record_and_files_bounded_by_bytes(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"{i} " * 300) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    records = warc.arcs_to_warc(warc.pages_to_arcs(warc.with_revisits(frame), 4096))
    warc.write_warc(records, str(tmp_path / "w"), 3)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) > 3
    seen = 0
    for f in files:
        data = f.read_bytes()
        assert len(gzip.decompress(data)) < 3 * (4096 + 40 * 900)  # any reader of gzip files can read them
        for member in warc.gzip_members(data):
            assert len(list(warc.read_warc(member))) == 1
            seen += 1
    assert seen == 60 + records.count()  # pages, and a warcinfo record an archive
    with pytest.raises(ValueError, match="torn"):
        list(warc.gzip_members(data[:-9]))


def test_identifiers():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 12345, None):
        assert warc.uuid_page(warc.record_uuid(i, "ABC")) == i


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [("http://a/x", b"HTTP/1.1 200 OK\r\n\r\nbody"), ("dns:a", b"1.2.3.4"), ("http://b", b"HTTP/1.0 404 No\n\n")]
    got = list(warc.read_arc(warc.write_arc(version, records)))
    assert [(h["URL"], b) for h, b in got[1:]] == records and tuple(got[1][0]) == warc.FIELDS[version]
    kinds = [warc.warc_record(h, b, 1, None, False) for h, b in got]
    assert [k.split(b"\r\n")[1] for k in kinds] == [b"WARC-Type: warcinfo", b"WARC-Type: response", b"WARC-Type: resource", b"WARC-Type: response"]
    back = list(warc.read_warc(b"".join(k + b"\r\n\r\n" for k in kinds)))
    assert [b for _, b in back[1:]] == [b for _, b in records] and back[1][0]["warc-date"] == "2024-01-01T00:00:00Z"


@pytest.mark.parametrize("data", [b"no end", b"filedesc://x 0 0 text/plain 5\n3 0 c", b"filedesc://x 0 0 text/plain 99\n1 0 c\n", b"filedesc://x 0 0 text/plain 6\n1 0 c\n\nu v 3\nabc\n"])
def test_torn_archives(data):
    with pytest.raises(ValueError):
        list(warc.read_arc(data))


def test_torn_warc():
    whole = warc.warc_record({"URL": "u", "IP-address": "-", "Archive-date": "2024", "Content-type": "t"}, b"HTTP/1.1 200 OK\r\n\r\nbody", 1, None, False) + b"\r\n\r\n"
    assert len(list(warc.read_warc(whole))) == 1
    for bad in (whole[:-6], whole[3:], whole.replace(b"Content-Length: 23", b"Content-Length: 22")):
        with pytest.raises(ValueError):
            list(warc.read_warc(bad))
