"""Packing by power-of-two decomposition: no padding, and no sequence crosses documents.

A document's ids are cut into pieces whose lengths are the powers of two of its length's binary form, those of the
longest sequence repeated as often as needed.  Each piece is a sequence of its own, in the bucket of its length; a
trainer draws batches bucket by bucket (say 1 of 4096 or 4 of 1024).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import wordbpe
from tidemill.llm.bpe import VOCABULARY
from tidemill.llm.common import table

LONGEST = 4096
CLOSING_ID = 2


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of ``n`` ids, longest first: powers of two that sum to n."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if (n % longest) >> k & 1]


class _Parts(dict):
    """Part of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: wordbpe.WordBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, parts: list[str]) -> None:
        """Encode new parts in one call of the public library: ids are dealt to the parts by their place in the text."""
        joined = " ".join(parts)
        found = self.bpe.library.encode(joined, add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        cut = np.searchsorted(at, ends).tolist()
        ids = np.array(found.ids, "<u4").tobytes()
        last = 0
        for p, c in zip(parts, cut):
            self[p] = ids[4 * last : 4 * c]
            last = c


_parts: dict[str, _Parts] = {}


def _memory(path: str) -> _Parts:
    if path not in _parts:
        bpe = wordbpe.load(path)
        bpe.library.no_truncation()
        bpe.library.no_padding()
        bpe.library.encode_special_tokens = True  # those in the raw text are cut out before; others are ordinary text
        _parts[path] = _Parts(bpe)
    return _parts[path]


def text_ids(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of whole texts as little-endian unsigned 32-bit integers, as the library gives them without specials."""
    known = _memory(path)
    if len(known) > wordbpe.MEMORY:
        known.clear()
    bpe, out = known.bpe, []
    for text in texts:
        ids = b""
        for part, special in bpe.segments(text or ""):
            if special:
                ids += np.array([bpe.special[part]], "<u4").tobytes()
                continue
            chunks = bpe.chunks(part)
            new = [c for c in set(chunks) if c not in known]
            if new:
                known.learn(new)
            ids += b"".join(map(known.__getitem__, chunks))
        out.append(ids)
    return out


def pack(docs: DataFrame, path: str, longest: int = LONGEST, closing: int = CLOSING_ID, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket) and with ``with_ids`` the ids
    as ``array<int>``.  ``longest`` is a power of two.  Null or empty text: one piece, the closing id.  Very long texts
    give as many pieces as they need.  Repeated rows are packed as often as they occur.  ``sequence_id`` is unique and not gapless; ``bucket`` is the length's exponent.
    Other columns are not read; an empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for i, ids in zip(b.column(0).to_pylist(), text_ids(b.column(1).to_pylist(), path)):
                ids += end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    piece = ids[4 * at : 4 * (at + length)]
                    for col, v in zip(rows, (i, at, length, zlib.crc32(piece), n)):
                        col.append(v)
                    if with_ids:
                        rows[5].append(np.frombuffer(piece, "<u4").astype(np.int32))
                    at += length
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = picked.mapInArrow(run, schema)
    first = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return pieces.select(
        *first,
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.round(F.log2("length")).cast("int").alias("bucket"),
        *["ids"] * with_ids,
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces (made with ids) with one folder for each length, so that readers batch equal lengths."""
    pieces.write.partitionBy("bucket").parquet(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
