"""BPE encoding and decoding of whole texts by forced-boundary splitting (see ``wordbpe``).

Work is a map over rows.  A worker remembers what it has found for parts of text between white space, up to a fixed
number of entries, so that frequent parts cost one look-up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import wordbpe
from tidemill.llm.common import table

VOCABULARY = "word_bpe_49k.json"


class _Parts(dict):
    """Part of text -> (ids as decimal text, tokens as text, number of ids); new parts are encoded when asked for."""

    def __init__(self, bpe: wordbpe.WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, part: str) -> tuple[str, str, int]:
        ids = self.bpe.chunk_ids(part)
        got = (" ".join(map(str, ids)), self.bpe.decode(ids), len(ids))
        if len(self) < wordbpe.MEMORY:
            self[part] = got
        return got


_parts: dict[str, _Parts] = {}


def _memory(path: str) -> _Parts:
    if path not in _parts:
        _parts[path] = _Parts(wordbpe.load(path))
    return _parts[path]


def encoded_forms(text: str | None, path: str) -> tuple[int, str, str]:
    """(number of ids, ids as decimal text, decoded text) of one whole text; null counts as empty."""
    known, n, ids, tokens = _memory(path), 0, [], []
    for part, special in known.bpe.segments(text or ""):
        if special:
            found = [(str(known.bpe.special[part]), part, 1)]
        else:
            found = [f for f in map(known.__getitem__, known.bpe.chunks(part)) if f[2]]
        ids += [f[0] for f in found]
        tokens += [f[1] for f in found]
        n += sum([f[2] for f in found])
    return n, " ".join(ids), " ".join(tokens)


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``decoded`` string added (replacing columns of these names)."""
    keep = [c for c in docs.columns if c not in ("ids", "decoded")]
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [encoded_forms(t, path) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            ids = pa.array([[int(i) for i in f[1].split()] for f in forms], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array([f[2] for f in forms], pa.string())], [*keep, "ids", "decoded"])

    return docs.select(*keep).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row.

    Null text counts as empty (no ids; digests of the empty string); very long texts are encoded whole; repeated rows
    stay repeated; other columns are
    not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column(1).to_pylist():
                count, as_text, tokens = encoded_forms(t, path)
                n.append(count)
                ids.append(hashlib.sha256(as_text.encode()).hexdigest())
                decoded.append(hashlib.sha256(tokens.encode()).hexdigest())
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
