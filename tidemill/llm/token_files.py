"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, each the ids of one document or of up to ``FRAME_IDS`` ids of a long one, then two
skippable frames: the directory of documents and the seek table of the public seekable format, whose entries give each
frame's sizes and the low half of the XXH64 of its content.  The whole file is a valid zstandard stream of all ids.  A
reader takes the table from the file's end and decompresses only the frames of the documents that it is asked for.

Documents are encoded where they are read; only compressed frames are shuffled, to ranges of doc_id.  Each range is
written as files of about ``FILE_BYTES`` by Spark's text sink, so any store will do; nothing holds more than a file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bytebpe
from tidemill.llm.common import fresh_path, materialise, partitions, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids in a frame at most.
FRAME_IDS = 1 << 16
#: Compressed bytes of frames after which a file is closed.
FILE_BYTES = 4 << 20
#: Texts that are encoded at a time.
TEXTS = 256
#: Fixed values of the zstandard and seekable formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
#: A document in the directory: its ids before it in its range of ids, its ids, its first frame and number of frames.
DOCUMENT = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("start", "<i8"), ("n", "<i8"), ("first", "<u4"), ("frames", "<u4")])
#: Directory head: number of the range, bytes of an id.
HEAD = struct.Struct("<qB")
LOWEST = -(2**63)


def pack_ids(ids: bytes, width: int, packer: zstandard.ZstdCompressor) -> tuple[bytes, bytes]:
    """(frames, their entries) of one document's ids, little-endian integers of ``width`` bytes."""
    frames, entries, size = [], [], FRAME_IDS * width
    for at in range(0, max(1, len(ids)), size):
        raw = ids[at : at + size]
        frames.append(packer.compress(raw))
        entries.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    return b"".join(frames), np.array(entries, ENTRY).tobytes()


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def file_image(part: int, width: int, docs: np.ndarray, frames: list[bytes], entries: list[bytes]) -> bytes:
    """A whole file but for its last four bytes, the magic number, which the sink writes."""
    directory = _skippable(SKIPPABLE, HEAD.pack(part, width) + docs.tobytes())
    listed = b"".join([*entries, np.array([(len(directory), 0, 0)], ENTRY).tobytes()])
    foot = struct.pack("<IBI", len(listed) // ENTRY.itemsize, CHECKSUMS, SEEKABLE)
    return (b"".join(frames) + directory + _skippable(SEEK_TABLE, listed + foot))[:-4]


class TokenFile:
    """Random access to the documents of one file.  ValueError: a torn or foreign file."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 9 or struct.unpack_from("<I", data, len(data) - 4)[0] != SEEKABLE:
            raise ValueError("no seek table at the end")
        n, kind = struct.unpack_from("<IB", data, len(data) - 9)
        size = n * ENTRY.itemsize + 9
        at = len(data) - size - 8
        if kind != CHECKSUMS or at < 0 or struct.unpack_from("<II", data, at) != (SEEK_TABLE, size):
            raise ValueError("no seek table of this kind")
        self.entries = np.frombuffer(data, ENTRY, n, at + 8)
        self.places = np.concatenate(([0], self.entries["packed"].astype(np.int64).cumsum()))
        if n < 1 or self.places[-1] != at:
            raise ValueError("frames don't fill the file")
        head = int(self.places[-2]) + 8
        if struct.unpack_from("<II", data, head - 8) != (SKIPPABLE, at - head):
            raise ValueError("no directory")
        self.part, self.width = HEAD.unpack_from(data, head)
        self.documents = np.frombuffer(data, DOCUMENT, (at - head - HEAD.size) // DOCUMENT.itemsize, head + HEAD.size)
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document; only its frames are decompressed."""
        d, raw = self.documents[i], []
        for f in range(int(d["first"]), int(d["first"]) + int(d["frames"])):
            entry = self.entries[f]
            try:
                one = self.unpacker.decompress(self.data[self.places[f] : self.places[f + 1]], max_output_size=max(1, int(entry["plain"])))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {f} is torn") from e
            if len(one) != entry["plain"] or xxhash.xxh64_intdigest(one) & 0xFFFFFFFF != entry["checksum"]:
                raise ValueError(f"frame {f} doesn't have its checksum")
            raw.append(one)
        found = np.frombuffer(b"".join(raw), f"<u{self.width}")
        if len(found) != d["n"]:
            raise ValueError(f"document {i} doesn't have its ids")
        return found


def _ranges(ids: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Limits of n ranges of about equal numbers of rows: values at which they begin, how many begin there, and the first.

    A value that many rows share begins several ranges, which split its rows by hash.
    """
    q = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], max(10_000, 20 * n)).alias("q"), F.min("doc_id").alias("low")).first()
    if q.low is None:
        return np.array([LOWEST]), np.array([1]), np.array([0])
    begins, times = np.unique(np.array([q.low, *q.q[1:]], np.int64), return_counts=True)
    return begins, times, np.concatenate(([0], times.cumsum()[:-1]))


def range_of(ids: np.ndarray, hashes: np.ndarray, begins: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The range of each (doc_id, hash as uint64); ranges are in ascending order of both."""
    at = np.maximum(np.searchsorted(begins, ids, side="right") - 1, 0)
    share = (hashes >> np.uint64(32)).astype(np.int64) * times[at] >> 32
    return (first[at] + np.where(ids == begins[at], share, times[at] - 1)).astype(np.int32)


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Encode whole texts, end each with ``end``, and write all in ascending order of doc_id to files below ``path``.

    Null text counts as empty: the end id alone.  Very long texts take several frames of one file.  Rows with equal
    doc_id are ordered by a hash of the text; equal rows are written as often as they occur, into one range.  A null
    doc_id is kept as null and ordered as the smallest long.  Other columns are not read; an empty table gives no file.
    """
    n = partitions(docs.sparkSession)
    own = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(id_col).isNull().alias("none"), F.xxhash64(own).alias("hash"), own.alias("text"))
    limits = _ranges(picked.select("doc_id"), n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = bytebpe.load(vocabulary), zstandard.ZstdCompressor(level=1, write_checksum=False)
        width = bpe.width
        last = np.array([end], f"<u{width}").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                hashes = b.column(2).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)  # in the order of the signed ones
                part = range_of(b.column(0).to_numpy(), hashes, *limits)
                packed = [pack_ids(ids + last, width, packer) for ids in bpe.ids(b.column(3).to_pylist())]
                cols = [pa.array(part), b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.binary()) for x in zip(*packed)), pa.array([width] * b.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "none", "hash", "frames", "entries", "width"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """File images of the ranges, in order."""
        held, rows, part, width, start, size, n_frames = [], [], None, 0, 0, 0, 0

        def closed() -> pa.RecordBatch:
            image = file_image(part, width, np.array(rows, DOCUMENT), [f for f, _ in held], [e for _, e in held])
            return pa.RecordBatch.from_arrays([pa.array([image], pa.binary())], ["value"])

        for b in batches:
            for new, doc, none, frames, entries, width_of in zip(*(b.column(i).to_pylist() for i in range(6))):
                if held and (new != part or size >= FILE_BYTES):
                    yield closed()
                    held, rows, size, n_frames = [], [], 0, 0
                if new != part:
                    part, start = new, 0
                width = width_of
                listed = np.frombuffer(entries, ENTRY)
                ids = int(listed["plain"].sum(dtype=np.int64)) // width
                rows.append((doc, none, start, ids, n_frames, len(listed)))
                held.append((frames, entries))
                start, size, n_frames = start + ids, size + len(frames), n_frames + len(listed)
        if held:
            yield closed()

    encoded = picked.mapInArrow(encode, "part int, doc_id long, none boolean, hash long, frames binary, entries binary, width int")
    ordered = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "none", "hash", "frames")
    images = ordered.select("part", "doc_id", "none", "frames", "entries", "width").mapInArrow(assemble, "value binary")
    as_text = images.select(F.col("value").cast("string").alias("value"))  # bytes stay as they are
    magic = struct.pack("<I", SEEKABLE).decode("latin-1")
    as_text.write.option("encoding", "ISO-8859-1").option("lineSep", magic).option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None, ids: bool = True) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids_crc32, ids) of the documents, or of those with one of ``doc_ids``.

    ``start`` counts the ids before the document within its range ``part``; ``ids`` is array<int>, left out on demand.
    Other documents' frames stay compressed.  Every checksum is compared; a torn file is a ValueError.
    """
    wanted = None if doc_ids is None else np.array(sorted(set(doc_ids)), np.int64)
    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                file = TokenFile(value.as_py())
                d = file.documents
                picked = np.arange(len(d)) if wanted is None else np.flatnonzero(np.isin(d["doc_id"], wanted) & (d["null"] == 0))
                for at in range(0, len(picked), TEXTS):
                    rows = []
                    for i in picked[at : at + TEXTS]:
                        found = file.ids(i).astype("<u4")
                        rows.append((file.part, None if d["null"][i] else int(d["doc_id"][i]), int(d["start"][i]), len(found), zlib.crc32(found.tobytes()), *[found.astype(np.int32)] * ids))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def with_global_starts(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with ``start`` counted over all ranges.  ``rows``: of all documents, written.

    The ranges' totals, one for each shuffle partition of the writer at most, are summed by the driver.
    """
    spark = rows.sparkSession
    base, before = [], 0
    for r in rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).orderBy("part").collect():
        base.append((r.part, before))
        before += r.n
    known = F.broadcast(spark.createDataFrame(base, "part int, base long"))  # as many rows as ranges
    return rows.join(known, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to seekable files and read back.  An empty table gives no rows."""
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), path)
    read = materialise(read_token_files(spark, path, ids=False), "token-rows")
    return with_global_starts(read)
