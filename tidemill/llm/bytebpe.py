"""Ids of whole texts under a byte-level BPE file of the tokenizers library, with a memory of parts of texts.

The library splits a text by a pattern before it merges.  Some places are always cut by that pattern: before a space
that is followed by something other than white space, around a line feed that stands between other characters, before a
comma or full stop that follows a letter or digit.  Texts are cut there and what lies between is looked up; what is new
goes to the library.  Texts with odd white space or marks are cut before such spaces only, and what is new then is cut
further by the pattern itself if all its characters are plain.  Texts with a special token's string, and files of any
other build, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer

#: Parts that a worker remembers at most.
MEMORY = 1_000_000
#: New parts that the library gets at a time.
NEW = 4096
#: White space (fixed values: Unicode's property White_Space).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters of ASCII and of two more blocks that hold only letters but for two signs.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTER}]*")
#: The split pattern of byte-level BPE (fixed value), for plain characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \\t\\n\\x0b\\x0c\\r0-9{_LETTER}]+|[ \\t\\n\\x0b\\x0c\\r]+(?![^ \\t\\n\\x0b\\x0c\\r])|[ \\t\\n\\x0b\\x0c\\r]+")
#: A space that no cut stands before, and whatever else keeps a text from being cut at all the places.
_NO_CUT = re.compile(f" (?:[{WHITE}]|$)")
_ODD = re.compile(f"[\0\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000 \n,.](?:(?<![ \n,.])|(?<=[ \n])(?=[{WHITE}]|$)|(?<=[,.])(?<![0-9{_LETTER}][,.]))")


def chunks(text: str) -> list[str]:
    """The text cut before each space that something other than white space follows."""
    pieces = text.split(" ")
    if not _NO_CUT.search(text):
        return [pieces[0], *(" " + p for p in pieces[1:])]
    out, at = [], 0
    for i in range(1, len(pieces)):
        if pieces[i] and pieces[i][0] not in WHITE:
            out.append(" " * (at > 0) + " ".join(pieces[at:i]))
            at = i
    return [*out, " " * (at > 0) + " ".join(pieces[at:])]


class ByteBpe:
    """Encoder of one vocabulary file; ids come as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        self.specials = [t["content"] for t in made.get("added_tokens", [])]
        feed = self._library_ids("\n")
        self.feed = int(feed[0]) if len(feed) == 1 else None
        self.known: dict[str, bytes] = {}

    def _library_ids(self, text: str) -> np.ndarray:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)  # the fast one counts no offsets
        return np.array(encode([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of parts without line feeds or space at the end; line feeds between them show where each ends."""
        for at in range(0, len(parts), NEW):
            some = parts[at : at + NEW]
            ids = self._library_ids("\n".join(some))
            ends = np.flatnonzero(ids == self.feed)
            if len(ends) == len(some) - 1:
                raw, w, last = ids.tobytes(), self.width, 0
                for p, end in zip(some, [*ends.tolist(), len(ids)]):
                    self.known[p] = raw[w * last : w * end]
                    last = end + 1
            else:
                self.known.update((p, self._library_ids(p).tobytes()) for p in some)

    def _looked_up(self, cut: list[list[str]]) -> list[bytes]:
        met: set[str] = set()
        for parts in cut:
            met.update(parts)
        new = {p for p in met if p not in self.known}
        alone = {p for p in new if self.feed is None or "\n" in p or p[-1:].isspace()}
        self._learn(list(new - alone))
        self.known.update((p, self._library_ids(p).tobytes()) for p in alone)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in cut]

    def _odd_ids(self, text: str) -> bytes:
        """Ids of a text that is cut before spaces only."""
        made = chunks(text)
        new = [c for c in set(made) if c not in self.known]
        self.known.update(zip(new, self._looked_up([_SPLIT.findall(c) if _PLAIN.fullmatch(c) else [c] for c in new])))
        return b"".join(map(self.known.__getitem__, made))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as the library gives them without the special tokens that a template adds."""
        if len(self.known) > MEMORY:
            self.known.clear()
        whole = [not self.cuts or any(s in t for s in self.specials) for t in texts]
        odd = [w or _ODD.search(t) is not None for t, w in zip(texts, whole)]
        mark = lambda t: t.replace(" ", "\0 ").replace("\n", "\0\n\0").replace(",", "\0,").replace(".", "\0.").split("\0")
        plain = iter(self._looked_up([mark(t) for t, o in zip(texts, odd) if not o]))
        return [next(plain) if not o else self._library_ids(t).tobytes() if w else self._odd_ids(t) for t, w, o in zip(texts, whole, odd)]


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, one for each worker."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
