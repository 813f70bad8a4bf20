"""A public word-level BPE vocabulary file, read by path: normalisation, words and forced-boundary encoding.

The file's own rules are followed: NFC, white space dropped, lower case; words by one pattern; the UTF-8 bytes of a
word, each shown as one character, merged by rank, with a mark at the word's end; ``<|...|>`` strings found in the
raw text are single tokens.

Forced boundaries: every merge result is a vocabulary token, so two neighbouring bytes that are neighbours in no
token can never come into one token.  A word is cut at all such pairs; the fragments are encoded each by itself, with
their own memory, and the ids put together.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import regex
import tokenizers

#: The word pattern of the vocabulary file, with white space as its engine sees it.
SPACE = r"\t-\r\x85\p{Z}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
END = "</w>"
#: White space to Python's str.split() that is none to the pattern.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Entries that a worker remembers before it starts anew.
MEMORY = 500_000
#: Symbols up to which a fragment is merged by looking through its pairs; longer ones use a heap.
SHORT = 48


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """Encoder over one vocabulary file; equal results to the public library on every text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.chars = byte_characters()
        # all pairs of neighbours within a token; the others are forced boundaries
        self.inner = {(t[i], t[i + 1]) for t in (v.removesuffix(END) for v in self.vocab) for i in range(len(t) - 1)}
        marks = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.find_words = regex.compile(WORD).findall
        self.fragments: dict[tuple[str, bool], list[int]] = {}
        # beyond Latin-1, where character classes depend on the Unicode version, the library's own rules cut words
        self.library = tokenizers.Tokenizer.from_file(path)

    def normal(self, text: str) -> str:
        """NFC, white space and lower case as the vocabulary file says."""
        if is_latin(text):
            return unicodedata.normalize("NFC", text).lower()
        return self.library.normalizer.normalize_str(text)

    def merge(self, fragment: str, last: bool) -> list[int]:
        """Ids of one fragment by merges of lowest rank, leftmost first; ``last``: it carries the word's end."""
        part = [*fragment]
        if last:
            part[-1] += END
        part = self._merge_short(part) if len(part) <= SHORT else self._merge_long(part)
        vocab = self.vocab
        return [vocab[p] for p in part]

    def _merge_short(self, part: list[str]) -> list[str]:
        get, never = self.rank.get, len(self.rank)
        ranks = [get(pair, never) for pair in zip(part, part[1:])]
        while ranks and (best := min(ranks)) < never:
            i = ranks.index(best)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), never)
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), never)
        return part

    def _merge_long(self, part: list[str]) -> list[str]:
        n, rank = len(part), self.rank
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j < 0 or rank.get((part[i], part[j])) != r:
                continue  # one of the two has been merged since
            part[i], part[j] = part[i] + part[j], ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (r := rank.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in part if p]

    def cut(self, symbols: str) -> list[str]:
        """The fragments of a word (bytes shown as characters) between forced boundaries."""
        inner, at, out = self.inner, 0, []
        for i in range(len(symbols) - 1):
            if (symbols[i], symbols[i + 1]) not in inner:
                out.append(symbols[at : i + 1])
                at = i + 1
        out.append(symbols[at:])
        return out

    def word_ids(self, shown: str) -> list[int]:
        """Ids of one word of the pattern, its bytes shown as characters."""
        known, out = self.fragments, []
        pieces = self.cut(shown)
        for k, piece in enumerate(pieces):
            key = (piece, k == len(pieces) - 1)
            ids = known.get(key)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = known[key] = self.merge(*key)
            out += ids
        return out

    def shown_words(self, chunk: str) -> list[str]:
        """Words of a part of a normalised text, each byte shown as a character."""
        if is_latin(chunk):
            chars = self.chars
            return ["".join([chars[b] for b in w.encode("utf-8")]) for w in self.find_words(chunk)]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens: (part, whether it is one)."""
        if self.split_special is None or "<|" not in text:
            return [(text, False)]
        return [(s, k % 2 == 1) for k, s in enumerate(self.split_special.split(text)) if s]

    def chunks(self, text: str) -> list[str]:
        """A segment cut at white space after normalisation; no word of the pattern crosses these cuts."""
        text = self.normal(text)
        return text.split(" ") if ODD_SPACE.search(text) else text.split()

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a part of a normalised text between white space."""
        return [i for w in self.shown_words(chunk) for i in self.word_ids(w)]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        for part, special in self.segments(text):
            if special:
                out.append(self.special[part])
            else:
                for c in self.chunks(part):
                    out += self.chunk_ids(c)
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file names no decoder: tokens joined by one space, special ones included."""
        return " ".join([self.token[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of a file, once in each worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
