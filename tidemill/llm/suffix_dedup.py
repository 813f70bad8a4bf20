"""Suffix-array dedup: repeats of a fixed least length, found by common-prefix interval trees, each kept once.

A text of ``window`` bytes is named by the smallest hash of its 32-byte strings, so equal windows have equal names
wherever they stand.  Neighbouring windows of one name form a *block* (about 35 windows of 100 bytes).  Blocks of one
name are compared by a suffix array, whatever their number; what precedes it only deals them out:

1. of equal blocks the two with the smallest places stand for their class, in each task and then over all.  Further
   copies, however many, never meet in one task: they repeat wherever the second one does, and that is everywhere;
2. names with one block only can't repeat and go no further.  A name that a batch holds often is salted by the block's
   hash, but for two of its blocks, by which its blocks elsewhere are seen to have company;
3. all others meet by name.  An enhanced suffix array of their texts (equal ones are sorted once) is scanned with a stack; every interval of the
   common-prefix tree whose occurrences differ to the left is a maximal repeat; all of its occurrences but the first
   are marked.  Any window that occurs twice lies in a maximal repeat with the same occurrences, so nothing else is
   needed.  (``repeats.maximal_repeats`` lists the groups with all occurrences; the dedup has no use for the first);
4. names whose blocks have more than ``limit`` bytes are not cut: their windows are named anew, by 64-byte strings and
   then by all of their bytes, and the shorter blocks under these names, which carry their texts, go through 1 to 3
   again.  A name of the last level has one text, so at most two blocks and, if it was salted, two more.

Blocks are told apart by 128 bits of hashes; all else compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import repeats
from tidemill.llm.common import materialise, partitions, table

#: Kinds of rows: a block, one in which a window may repeat, a further copy of two blocks, and a block of a salted name.
PLAIN, TWICE, KNOWN, SALTED = 0, 1, 2, 3
#: Blocks of one name in a batch from which on all but two are salted.
OFTEN = 8
BLOCK_SCHEMA = "key long, body long, doc long, start int, n int, kind int"
FOUND_SCHEMA = "doc long, start int, n int, key long, contested boolean"
SPAN_SCHEMA = "doc long, start int, n int"
SPAN_COLUMNS = ("doc", "start", "n")
#: Suffixes share lengths up to this many windows' worth of bytes; longer repeats are found in overlapping parts.
CAP = 224
#: Bytes of text laid end to end at once: of documents, and of contested blocks.
LAID, CONTESTED = 1 << 22, 1 << 19
#: Bytes of documents whose blocks a task holds at once, however many and long the rows of a batch are.
TOGETHER = 1 << 24
#: Windows of a block that is named anew at once.
PIECE = 1 << 16
#: Bytes of contested blocks of one name from which on its windows are named anew by longer strings.
LIMIT = 2 << 20


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _block_rows(name: np.ndarray, body: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, twice: np.ndarray, *texts: np.ndarray) -> pa.RecordBatch:
    """Rows of the blocks of one batch, in order of (doc, start): copies of two earlier ones are known repeats, without a text."""
    both = name * np.uint64(0x9E3779B97F4A7C15) + body
    order = np.argsort(both, kind="stable")
    a, b = order[:-1], order[1:]
    equal = (name[a] == name[b]) & (body[a] == body[b]) & (n[a] == n[b])
    same = np.zeros(len(both), bool)
    same[order[2:]] = equal[1:] & equal[:-1]
    kind = np.where(same, KNOWN, np.where(twice, TWICE, PLAIN))
    rest = np.flatnonzero(~same)
    rest = rest[np.argsort(name[rest], kind="stable")]
    edge = np.flatnonzero(np.concatenate(([True], name[rest][1:] != name[rest][:-1])))
    size = np.diff(np.concatenate((edge, [len(rest)])))
    nth = np.arange(len(rest)) - np.repeat(edge, size)
    kind[rest[(np.repeat(size, size) >= OFTEN) & (nth >= 2)]] = SALTED
    # neighbouring known repeats of one text become one row, dealt out by its place
    joins = np.concatenate(([False], same[1:] & same[:-1] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + n[:-1])))
    head = np.flatnonzero(~joins)
    total = np.add.reduceat(n, head) if len(head) else n
    name = np.where(same, repeats._mix(doc.astype(np.uint64) * np.uint64(31) + start.astype(np.uint64)), name)[head]
    cols = [_i64(name), _i64(body[head]), _i64(doc[head]), pa.array(start[head].astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(kind[head].astype(np.int32))]
    cols += [pa.array(np.where(same, None, t)[head], pa.binary()) for t in texts]
    return pa.RecordBatch.from_arrays(cols, ["key", "body", "doc", "start", "n", "kind", "text"][: len(cols)])


def _scan(window: int, gram: int, inline: bool = False):
    """Blocks of texts (doc, start, text), by names of ``gram`` bytes; with their own texts if ``inline``."""

    def laid(pieces: list[tuple]) -> list[np.ndarray] | None:
        docs, starts, texts = zip(*pieces)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        raw = b"".join(texts)
        name, at, n, twice = repeats.blocks(np.frombuffer(raw, np.uint8), offsets, window, gram)
        if not len(name):
            return None
        if gram == window:  # a name of equal neighbours is one text too
            name, at = np.repeat(name, n), np.repeat(at - n.cumsum() + n, n) + np.arange(n.sum())
            n, twice = np.ones(len(at), np.int64), np.zeros(len(at), bool)
        x = xxhash.xxh3_64_intdigest
        cut = [slice(s, e) for s, e in zip(at.tolist(), (at + n + window - 1).tolist())]
        body = np.array([x(raw[c]) for c in cut], np.uint64)
        text = np.searchsorted(offsets, at, side="right") - 1
        own = [np.array([raw[c] for c in cut], object)] if inline else []
        return [name, body, np.array(docs, np.int64)[text], at - offsets[text] + np.array(starts, np.int64)[text], n, twice, *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, start = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = b.column(2)
            parts, held, size, total = [], [], 0, 0
            for i in [*np.lexsort((start, doc)).tolist(), None]:
                if held and (i is None or size > (CONTESTED if inline else LAID)):
                    if found := laid(held):
                        parts.append(found)
                    held, size, total = [], 0, total + size
                    if parts and (inline or total >= TOGETHER):  # texts of single windows are many times as long as the text they are from
                        yield _block_rows(*(np.concatenate(c) for c in zip(*parts)))
                        parts, total = [], 0
                if i is not None and (text := texts[i].as_py()):
                    held.append((doc[i], start[i], text))
                    size += len(text)
            if parts:
                yield _block_rows(*(np.concatenate(c) for c in zip(*parts)))

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCK_SCHEMA sorted by (key, body, doc, start): third and further copies, and the other blocks of contested names.

    If the rows have texts, the latter keep them.
    """
    held = None  # the last block that is no such copy; its name may go on in the next batch
    last, seen = None, 0  # (key, body, n) of the last row, and how many rows had it
    contested_before = False
    for b in batches:
        key, body, doc, start, n, kind, *texts = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        known = kind == KNOWN
        if known.any():
            i = np.flatnonzero(known)
            yield _found(False, doc[i], start[i], n[i], key[i], *(t[i] for t in texts))
            i = np.flatnonzero(~known)
            key, body, doc, start, n, kind, *texts = (c[i] for c in (key, body, doc, start, n, kind, *texts))
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (body[1:] != body[:-1]) | (n[1:] != n[:-1])
        new[0] = last != (key[0], body[0], n[0])
        nth = np.arange(len(key))
        nth = nth - np.maximum.accumulate(np.where(new, nth, -seen))
        last, seen = (key[-1], body[-1], n[-1]), int(nth[-1]) + 1
        copy = nth >= 2
        i = np.flatnonzero(copy)
        yield _found(False, doc[i], start[i], n[i], key[i], *(np.full(len(i), None) for _ in texts))
        i = np.flatnonzero(~copy)
        rows = [c[i] for c in (doc, start, n, key, *texts, kind)]
        if held is not None:
            rows = [np.concatenate((h, c)) for h, c in zip(held, rows)]
        key, kind = rows[3], rows[-1]
        if not len(key):
            continue
        pair = key[1:] == key[:-1]
        disputed = (kind != PLAIN) | np.concatenate(([contested_before], pair)) | np.concatenate((pair, [False]))
        i = np.flatnonzero(disputed[:-1])
        yield _found(True, *(c[i] for c in rows[:-1]))
        contested_before = bool(pair[-1]) if len(pair) else contested_before
        held = [c[-1:] for c in rows]
    if held is not None and (contested_before or held[-1][0] != PLAIN):
        yield _found(True, *held[:-1])


def _found(contested: bool, doc: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, *texts: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(np.full(len(doc), contested))]
    return pa.RecordBatch.from_arrays(cols + [pa.array(t, pa.binary()) for t in texts], ["doc", "start", "n", "key", "contested", "text"][: 5 + len(texts)])


def _interval_trees(window: int):
    """Contested blocks with their texts, sorted by (key, doc, start): all occurrences of maximal repeats but the first."""

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        texts, doc, start = [p[3] for p in parts], np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
        size = np.array([len(t) for t in texts])
        at = np.concatenate(([0], size.cumsum()))
        # blocks are laid in order of (doc, start) within a name, so the smallest place is the first occurrence
        buffer, begins, ends = np.frombuffer(b"".join(texts), np.uint8), np.repeat(at[:-1], size), np.repeat(at[1:], size)
        place, length = repeats.later_repeats(buffer, begins, ends, window, max(CAP, window))
        marks = np.zeros(at[-1] + 1, np.int64)  # windows that repeat, as runs; none crosses a block
        np.add.at(marks, place, 1)
        np.add.at(marks, place + length - window + 1, -1)
        edge = np.diff(np.concatenate(([0], (marks.cumsum() > 0).view(np.int8))))
        place, n = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = n - place
        block = np.searchsorted(at, place, side="right") - 1
        cols = [pa.array(doc[block], pa.int64()), pa.array(start[block] + place - at[block], pa.int32()), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["doc", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if size > CONTESTED and row[0] != parts[-1][0]:
                    yield solve(parts)
                    parts, size = [], 0
                parts.append(row)
                size += len(row[3])
        if parts:
            yield solve(parts)

    return run


def _numbered(docs: DataFrame, text_col: str, id_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc, text as bytes), the columns ``more`` and, if it differs from doc, doc_id: ``doc`` orders the documents.

    It is the doc_id itself, unless that is null or repeated somewhere; then rows are numbered by (doc_id, text), null
    ids first.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)
    unclear = named.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if unclear.isEmpty():
        return named.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text", *more)
    ordered = named.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.select(F.monotonically_increasing_id().alias("doc"), "text", *more, "doc_id"), "numbered")


def repeated_windows(numbered: DataFrame, window: int = 100, limit: int = LIMIT) -> DataFrame:
    """(doc, start, n): windows of ``window`` bytes at start .. start + n - 1 also start earlier.  Rows may overlap.

    ``numbered``: (doc, text as bytes); "earlier": a smaller doc, or the same and a smaller start.
    """
    if window < repeats.GRAM:
        raise ValueError(f"window must be at least {repeats.GRAM} bytes")
    parts = partitions(numbered.sparkSession)

    def dealt(rows: DataFrame, gram: int, more: str) -> DataFrame:
        """Copies and contested blocks; a salted name is dealt out by the block's hash, and sorting by name first brings what meets together."""
        by = F.when(F.col("kind") == SALTED, F.xxhash64("key", "body")).otherwise(F.col("key"))
        blocks = rows.mapInArrow(_scan(window, gram, bool(more)), BLOCK_SCHEMA + more).repartition(parts, by)
        return blocks.sortWithinPartitions("key", "body", "doc", "start").mapInArrow(_resolve, FOUND_SCHEMA + more)

    def too_long(contested: DataFrame) -> DataFrame:
        """Names of more than ``limit`` bytes of blocks."""
        size = F.sum(F.col("n").cast("long") + window - 1)
        return contested.groupBy("key").agg(size.alias("size")).where(F.col("size") > limit).select("key", F.lit(True).alias("hot"))

    def solved(cut: DataFrame) -> DataFrame:
        met = cut.select("key", "doc", "start", "text").repartition(parts, "key").sortWithinPartitions("key", "doc", "start")
        return met.mapInArrow(_interval_trees(window), SPAN_SCHEMA)

    first, *longer = sorted({repeats.GRAM, min(2 * repeats.GRAM, window), window})
    found = materialise(dealt(numbered.select("doc", F.lit(0).alias("start"), "text"), first, ""), "blocks")
    contested = found.where("contested")
    hot = materialise(too_long(contested), "hot-names") if longer else None
    if hot is None or hot.isEmpty():
        longer = []
    marked = contested.join(hot, "key", "left") if longer else contested.withColumn("hot", F.lit(None).cast("boolean"))
    asked = marked.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("asked"))  # at most one text's blocks
    cut = (
        asked.join(numbered.select("doc", "text"), "doc").select("doc", "text", F.explode("asked").alias("a"))
        .select("a.key", "doc", "a.start", F.expr(f"substring(text, a.start + 1, a.n + {window - 1})").alias("text"), "a.hot")
    )
    spans = found.where("not contested").select(*SPAN_COLUMNS).unionByName(solved(cut.where("hot is null")))
    # blocks of long names carry their texts from here on, so that documents aren't shuffled again for them
    for gram in longer:
        part = F.explode(F.expr(f"sequence(0, length(text) - {window}, {PIECE})")).alias("p")
        pieces = cut.where("hot").select("doc", "start", "text", part)
        rows = pieces.select("doc", (F.col("start") + F.col("p")).alias("start"), F.expr(f"substring(text, p + 1, {PIECE + window - 1})").alias("text"))
        # in a fixed order, as the salt depends on what else is in a batch: a task that is run again must deal alike
        found = dealt(rows.sortWithinPartitions("doc", "start"), gram, ", text binary")
        contested = found.where("contested")
        cut = contested.join(too_long(contested), "key", "left") if gram < window else contested.withColumn("hot", F.lit(None).cast("boolean"))
        spans = spans.unionByName(found.where("not contested").select(*SPAN_COLUMNS)).unionByName(solved(cut.where("hot is null")))
    return spans


def _kept(text: bytes, starts: np.ndarray, counts: np.ndarray, window: int) -> tuple[bytes, int]:
    """What is left of a text, and the number of removed runs."""
    gone = np.zeros(len(text) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, starts + counts + window - 1, -1)
    gone = gone[:-1].cumsum() > 0
    runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), runs


def _each_kept(window: int):
    """For a batch with texts and lists of spans in its columns 1 and 2: (text, what is left, removed runs) of each row."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
        lists = b.column(2)
        flat, ends = lists.values, lists.offsets.to_numpy()
        starts, counts = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        for i, text in enumerate(b.column(1).to_pylist()):
            text, s = text or b"", slice(ends[i], ends[i + 1])
            kept, runs = _kept(text, starts[s], counts[s], window) if ends[i + 1] > ends[i] else (text, 0)
            yield text, kept, runs

    return rows


def _with_spans(numbered: DataFrame, window: int, limit: int) -> DataFrame:
    """``numbered`` with the list of each text's spans of repeated windows (null if there are none)."""
    spans = repeated_windows(numbered, window, limit).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # the texts are shuffled by doc once, for this join and for the one that cuts out contested blocks, if no more columns go along
    return numbered.join(spans, "doc", "left")


def removed(docs: DataFrame, window: int = 100, limit: int = LIMIT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What is left of each text without the bytes of windows that start earlier.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256).  Null text counts as empty, and texts under ``window``
    bytes lose nothing.  Rows with repeated or null doc_ids are told apart and ordered by (doc_id, text), null first;
    of equal rows all but one count as later.  Other columns are not read; an empty table gives no rows.
    """
    numbered = _numbered(docs, text_col, id_col)
    own_id = "doc_id" if "doc_id" in numbered.columns else "doc"
    names, each = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], _each_kept(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for t, k, n in each(b)]
            cols = [b.column(0), *(pa.array([g[i] for g in got], kind) for i, kind in enumerate([*[pa.int64()] * 3, pa.string()]))]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(numbered, window, limit).select(own_id, "text", "spans").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, window: int = 100, limit: int = LIMIT) -> DataFrame:
    """``docs`` with all its columns: text without repeated windows, n_chars (if it is there) counted anew.

    Characters that lost some of their bytes go too.  All rows stay, even if nothing is left of their text; ``removed``
    says how odd rows are treated.
    """
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    hidden = {c: f"_{i}" for i, c in enumerate(more)}  # names that clash with nothing
    numbered = _numbered(docs.select("doc_id", "text", *(F.col(c).alias(h) for c, h in hidden.items())), "text", "doc_id", tuple(hidden.values()))
    own_id = "doc_id" if "doc_id" in numbered.columns else "doc"
    each = _each_kept(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [k.decode("utf-8", "ignore") for _, k, _ in each(b)]
            cols = [b.column(0), pa.array(left, pa.string()), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", *b.schema.names[3:]])

    joined = _with_spans(numbered, window, limit).select(F.col(own_id).alias("doc_id"), "text", "spans", *hidden.values())
    left = joined.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *joined.schema.fields[3:]]))
    fresh = {c: F.col(h) for c, h in hidden.items()} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in fresh:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return left.select(*(fresh[c].alias(c) for c in docs.columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier in the corpus."""
    return removed(table(spark, sf_dir, "documents"))


#: Windows as byte strings, numbered within equal ones; repeats that touch or overlap make one removed run.
ORACLE = """
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, array_slice(b, s + 1, s + 100) AS piece FROM (SELECT doc_id, b, unnest(range(0, n - 99)) AS s FROM d WHERE n >= 100)
), r AS (
  SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY piece ORDER BY doc_id, s) > 1
), e AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS begins FROM r
), g AS (
  SELECT doc_id, s, sum(begins) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM e
), runs AS (
  SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM g GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS done FROM runs
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS tail,
    string_agg(hex(array_slice(b, done + 1, lo)), '' ORDER BY lo) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(array_slice(b, coalesce(tail, 0) + 1, n)))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
