"""Quality classifier: a generalised additive model with pairwise interactions.

Each whole text becomes a row of numbers.  Boosting goes round the features: each turn fits a shallow tree to the
gradient along one feature and adds it to that feature's look-up table; then the same for a few pairs of features
with the largest gain.  A score is the sum of table entries through the logistic function, so scoring a batch is one
binning and one addition for each feature or pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "bangs_per_word", "bars_per_word",
    "symbols_per_word", "stops_per_word", "new_words", "again_words", "upper_lines", "symbol_lines", "again_lines",
    "wide_share", "entropy", "same_lines", "log_longest", "log_lines",
)
SYMBOLS = b"#$%&*<>{}[]\\^~_=+@"
#: Labelled rows that a model is fitted on at most: those whose hashed doc_id is smallest.
SAMPLE = 20_000
THRESHOLD = 0.3


def text_features(text: bytes | None) -> list[float]:
    """The numbers of one whole text (FEATURES); null counts as empty, which gives zeros."""
    text = text or b""
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    n, w = len(text), len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    share = counts[counts > 0] / n
    up = sym = again = 0
    lines = [x for x in text.split(b"\n") if x]
    for line in lines:
        if line.isupper():
            up += len(line)
        if 20 * (len(line) - len(line.translate(None, b"!|" + SYMBOLS))) > len(line):
            sym += len(line)
        parts = line.split()
        if 5 * sum(map(eq, parts, parts[1:])) > len(parts):
            again += len(line)
    return [
        float(np.log1p(n)), float(np.log1p(w)), (n - w) / w, upper / max(1, upper + lower), counts[48:58].sum() / n,
        counts[33] / w, counts[124] / w, sum(counts[c] for c in SYMBOLS) / w, (counts[44] + counts[46]) / w,
        float(np.log1p(len(set(words))) / np.log1p(w)), sum(map(eq, words, words[1:])) / w, up / n, sym / n, again / n,
        counts[128:].sum() / n, float(-(share * np.log2(share)).sum()), 1 - len(set(lines)) / len(lines),
        float(np.log1p(max(map(len, words)))), float(np.log1p(len(lines))),
    ]


@dataclass
class Gam:
    """Base log-odds, bin edges of each feature, a table for each feature and for some pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(x) and self.edges:
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[:, j]]
            for (i, j), t in self.pairs.items():
                total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Values of a tree along one axis: cuts are taken where the gain is largest, one after another."""
    cg, ch = np.concatenate(([0], g.cumsum())), np.concatenate(([0], h.cumsum()))
    ends = [0, len(g)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(ends, ends[1:]):
            cut = np.arange(a + 1, b)
            if len(cut):
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(cut[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        ends = sorted([*ends, best[1]])
    return np.concatenate([np.full(b - a, (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)) for a, b in zip(ends, ends[1:])])


def _quadrants(g: np.ndarray, h: np.ndarray, damp: float) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four by one line each way: gain and values."""
    cg, ch = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    r, c = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]

    def four(x):
        a, b, d = x[r, c], x[r, -1:] * np.ones_like(c), x[-1:, c] * np.ones_like(r)
        b, d = b.reshape(len(r), -1), d.reshape(-1, c.shape[1])
        return a, b - a, d - a, x[-1, -1] - b - d + a

    gain = sum(p**2 / (q + damp) for p, q in zip(four(cg), four(ch)))
    k, m = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    for rows, cols in ((slice(0, k + 1), slice(0, m + 1)), (slice(0, k + 1), slice(m + 1, None)), (slice(k + 1, None), slice(0, m + 1)), (slice(k + 1, None), slice(m + 1, None))):
        out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + damp)
    return float(gain[k, m]), out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, leaves: int = 3, max_bins: int = 32, n_pairs: int = 6, pair_rounds: int = 60, damp: float = 5.0) -> Gam:
    """Fit by cyclic boosting.  No rows: scores of one half; one class only: its share, smoothed by one row of each."""
    model, n = Gam(), len(y)
    p = (y.sum() + 1) / (n + 2)
    model.base = float(np.log(p / (1 - p)))
    if n == 0 or y.min() == y.max():
        return model
    for j in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, j], np.linspace(0, 1, max_bins + 1)[1:-1])))
    b = model.bins(x)
    size = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in size]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, s in enumerate(size):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s), leaves, damp)
            model.tables[j] += step
            total += step[b[:, j]]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, i] * size[j] + b[:, j], v, size[i] * size[j]).reshape(size[i], size[j])

    g, h = slopes()
    gains = {(i, j): _quadrants(grid(i, j, g), grid(i, j, h), damp)[0] for i in range(len(size)) for j in range(i)}
    chosen = sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]
    model.pairs = {k: np.zeros((size[k[0]], size[k[1]])) for k in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            g, h = slopes()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h), damp)[1]
            model.pairs[i, j] += step
            total += step[b[:, i], b[:, j]]
    return model


def _held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for rows (doc_id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([text_features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


def _picked(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", id_col: str = "doc_id") -> Gam:
    """A model of ``labels.quality``, from at most ``sample`` labelled documents that aren't held out.

    Labels that are null or belong to no document count for nothing; if a document has several, the smallest holds.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).where(~_held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most sample rows of 12 bytes, so it may be broadcast
    x = _featured(_picked(docs, text_col, id_col).join(F.broadcast(chosen), "doc_id", "left_semi"))
    rows = x.join(F.broadcast(chosen), "doc_id").select("doc_id", "x", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not rows:
        return Gam()
    return fit_gam(np.array([r.x for r in rows]), np.array([float(r.quality) for r in rows]))


def score_quality(docs: DataFrame, model: Gam, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Null and empty texts are scored like any text, very long ones whole.  Equal texts have equal scores, repeated rows stay repeated; a null doc_id is not held out; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = _picked(docs, text_col, id_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``threshold``, with all their columns as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features((t or "").encode("utf-8")) for t in b.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
