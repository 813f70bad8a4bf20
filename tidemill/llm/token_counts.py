"""Word-piece counts by a linear longest-match automaton.

A trie of the vocabulary has failure links, and each link knows how many tokens are taken off when it is followed.  A
word is read once, character by character; the counts on the way sum to the number of greedy longest-match pieces,
and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import wordbpe
from tidemill.llm.bpe import VOCABULARY
from tidemill.llm.common import table


class LongestMatch:
    """Counts greedy pieces: ``first`` may begin a word, ``inner`` may follow within it."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]  # 0: a word's begin, 1: behind a piece
        token = [False, False]
        for root, words in ((0, first), (1, inner)):
            for w in words:
                at = root
                for c in w:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        token.append(False)
                    at = self.child[at][c]
                token[at] = token[at] or at > 1
        self.fail, self.popped = [-1] * len(token), [0] * len(token)
        todo = deque([0, 1])
        while todo:  # by depth, so the links of all shorter strings are there
            u = todo.popleft()
            for c, v in self.child[u].items():
                todo.append(v)
                if token[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                z, n = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.child[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.child[z][c], n

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it can't be cut into pieces."""
        child, fail, popped, at, n = self.child, self.fail, self.popped, 0, 0
        for c in word:
            while (to := child[at].get(c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = to
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


_automata: dict[str, tuple[wordbpe.WordBpe, LongestMatch, dict[str, tuple[int, int, int]]]] = {}


def _automaton(path: str):
    if path not in _automata:
        bpe = wordbpe.load(path)
        pieces = {t.removesuffix(wordbpe.END) for t in bpe.vocab} - {""}
        _automata[path] = (bpe, LongestMatch(pieces, pieces), {})
    return _automata[path]


def text_counts(text: str | None, path: str) -> tuple[int, int, int]:
    """(words, pieces, words that can't be cut) of a whole text."""
    bpe, match, known = _automaton(path)
    words = pieces = unknown = 0
    for part in bpe.chunks(text or ""):
        got = known.get(part)
        if got is None:
            counts = [match.count(w) for w in bpe.shown_words(part)]
            got = (len(counts), sum(c or 1 for c in counts), sum(not c for c in counts))
            if len(known) < wordbpe.MEMORY:
                known[part] = got
        words += got[0]
        pieces += got[1]
        unknown += got[2]
    return words, pieces, unknown


def token_counts(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each row; a word that can't be cut counts as one token.

    Words are those of the vocabulary file's own pattern, as bytes.  Null text counts as empty (zeros); repeated rows
    stay repeated; very long texts and words are counted whole, in time linear in their length; other columns are not read;
    an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [text_counts(t, path) for t in b.column(1).to_pylist()]
            cols = [b.column(0), *(pa.array([g[k] for g in got], pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece counts of every whole document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
