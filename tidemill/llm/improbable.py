"""Document fingerprints: improbable-feature digests.

Every 64-byte window of a text has an entropy.  By the method of types, the lower the entropy of a window's bytes, the
fewer windows of all possible ones look like it: windows are ranked by it, least probable first.  (Windows that hold
almost one byte only, such as rulings and padding, say nothing about a text and are left out.)  Among each 64
neighbouring windows the one with the lowest rank gets a point, the first if there are several; windows with enough
points are features.  Features go into Bloom filters of 2048 bits, 160 in each, chained as the text goes on.  Two
digests are compared filter by filter through the share of common bits beyond chance.

Adjacent documents meet without a total sort: ids are cut into ranges that begin with existing ids, and the document
that begins a range is also handed to the range before.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import partitions, table
from tidemill.llm.repeats import sliding_min

WINDOW = 64
#: Windows that compete for a point, and points that make a feature.
NEIGHBOURS, POINTS = 64, 16
#: Entropy in bits below which a window is left out.
TRIVIAL = 1.0
#: Bits of a filter, bits set for a feature, and features of a filter.
BITS, HASHES, FEATURES = 2048, 5, 160
_UNIT = 1 << 16
_TERM = np.array([0, *(round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1))], np.int64)
_UP = np.diff(_TERM)  # what one more of a byte adds


def window_surprise(b: np.ndarray) -> np.ndarray:
    """Sum of c log2 c over the byte counts of each window, in units of 1/65536; entropy is 6 minus a 64th of it."""
    n = len(b)
    order = np.argsort(b, kind="stable")
    key = b[order].astype(np.int64) * (2 * n + 2 * WINDOW) + order  # by byte, then place
    rank = np.arange(n)
    earlier, later = np.empty(n, np.int64), np.empty(n, np.int64)
    earlier[order] = rank - np.searchsorted(key, key - (WINDOW - 1))  # the same byte in the 63 places before
    later[order] = np.searchsorted(key, key + (WINDOW - 1), side="right") - rank  # and from here in 64 places
    gain = _UP[earlier]
    loss = _UP[later[: n - WINDOW] - 1]
    gain[WINDOW:] -= loss  # the window moves on: its first byte leaves before the next comes
    return gain.cumsum()[WINDOW - 1 :]


def features(b: np.ndarray) -> np.ndarray:
    """Places of the features of a text of at least 64 bytes."""
    surprise = window_surprise(b)
    n = len(surprise)
    most = WINDOW * 6 * _UNIT
    rank = np.where(surprise > most - TRIVIAL * WINDOW * _UNIT, most + 1, most - surprise)  # low entropy first, trivial last
    mixed = rank * n + np.arange(n)
    if n > NEIGHBOURS:
        points = np.bincount(sliding_min(mixed, NEIGHBOURS) % n, minlength=n)
        return np.flatnonzero((points >= POINTS) & (rank <= most))
    best = int(mixed.argmin())
    return np.array([best] if rank[best] <= most else [], np.int64)


def digest(text: bytes) -> bytes:
    """Chained filters, 256 bytes each.  Empty text: nothing; a text without a feature: itself is the one feature."""
    if not text:
        return b""
    b = np.frombuffer(text, np.uint8)
    places = features(b).tolist() if len(b) >= WINDOW else []
    found = [text[p : p + WINDOW] for p in places] or [text]
    h = np.array([xxhash.xxh3_64_intdigest(f) for f in found], np.uint64)
    at = np.stack([(h >> np.uint64(11 * k)) & np.uint64(BITS - 1) for k in range(HASHES)], axis=1).astype(np.int64)
    which = np.arange(len(found)) // FEATURES
    bits = np.zeros((which[-1] + 1, BITS), np.uint8)
    bits[np.repeat(which, HASHES), at.ravel()] = 1
    return np.packbits(bits, axis=1).tobytes()


def likeness(one: bytes, other: bytes) -> float:
    """0 to 1.  Each filter of the digest with fewer of them takes its best match; the mean is weighted by set bits.

    A match is the number of common bits beyond what chance gives two filters so full, over what is possible.  Equal
    digests are 1 alike, so are two empty ones; an empty and a filled one are 0 alike.
    """
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) for x in (one, other))
    if len(a) > len(b) or (len(a) == len(b) and one > other):
        a, b = b, a
    na, nb = a.sum(1), b.sum(1)
    best = np.zeros(len(a))
    for i in range(0, len(b), 512):  # bounded memory for very long texts
        part, size = b[i : i + 512], nb[None, i : i + 512]
        chance = na[:, None] * size / BITS
        possible = np.minimum(na[:, None], size) - chance
        best = np.maximum(best, ((a @ part.T - chance) / np.maximum(possible, 1e-9)).max(1))
    return float(np.clip((np.clip(best, 0, 1) * na).sum() / na.sum(), 0, 1))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _shown(d: bytes) -> str:
    return base64.b64encode(d).decode()


def _ranges(docs: DataFrame, n: int) -> list[int]:
    """Existing doc_ids at which ranges of about equal numbers of rows begin; the smallest id is the first."""
    found = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(n)], 20 * n).alias("q"), F.min("doc_id").alias("low")).first()
    return sorted({found.low, *found.q}) if found.low is not None else []


def fingerprint_pairs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Next is the row that follows by (doc_id, text); after the last the first.  Null text counts as empty; one row alone
    follows itself.  Rows with a null doc_id come first.  Very long texts are read whole and chain as many filters as
    they need.  Other columns are not read; an empty table gives no rows.
    """
    n = partitions(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    begins = _ranges(picked, 4 * n)
    nulls = -1 if not picked.where("doc_id is null").limit(1).isEmpty() else 0  # a range before the others
    starts = np.array(begins, np.int64)
    last = len(begins) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its range; rows that begin a range once more, behind the rows of the range before."""
        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            at = np.where(null, nulls, np.searchsorted(starts, ids, side="right") - 1)
            first = np.where(null, True, starts[np.maximum(at, 0)] == ids if len(starts) else True)
            i = np.flatnonzero(first)
            before = np.where(at[i] > nulls, at[i] - 1, last)
            rows = pa.Table.from_batches([b]).take(pa.array(np.concatenate((np.arange(len(at)), i)))).combine_chunks()
            group, ahead = np.concatenate((at, before)), np.concatenate((np.zeros(len(at), bool), np.ones(len(i), bool)))
            out = rows.append_column("part", pa.array(group.astype(np.int32))).append_column("ahead", pa.array(ahead))
            yield from out.to_batches()

    dealt = picked.mapInArrow(deal, "doc_id long, text string, part int, ahead boolean")
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, digest) that waits for the row that follows
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text, part, ahead in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = held[3] if held is not None and text == held[2] else digest(text.encode())
                if held is not None and held[0] == part:
                    edited = edited_text(held[2], text).encode()
                    changed = digest(edited)
                    got = (held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), _shown(held[3]), _shown(changed), likeness(held[3], changed), likeness(held[3], own))
                    for col, v in zip(rows, got):
                        col.append(v)
                held = None if ahead else (part, doc, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and their likeness to those and to the next document."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
