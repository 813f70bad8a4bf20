"""Numpy helpers on bytes: content-defined blocks of windows, and maximal repeats by an enhanced suffix array."""

from __future__ import annotations

import numpy as np

#: Bytes of the small strings whose smallest hash names a window.
GRAM = 32
#: Windows handled at once.
SLICE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (constants of the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` bytes, by doubling; the last two parts overlap unless ``size`` is a power of two.  ``b``: uint8."""
    h, have = _BYTE[b], 1
    while have < size:
        step = min(have, size - have)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + h[step:]
        have += step
    return _mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def blocks(buffer: np.ndarray, offsets: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one name, in texts laid end to end.

    A window's name is the smallest hash of its ``gram``-byte strings, so equal windows have equal names.  Returns
    (name, start in the buffer, number of windows, whether the named string may occur twice) of the maximal runs; no
    window crosses a text.  Only in a run of the last kind can a window repeat within the run.
    ``offsets``: where the texts start, and the end of the last.
    """
    n = len(buffer) - window + 1
    if n <= 0:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, np.empty(0, bool)
    names, starts, before = [], [], None
    for at in range(0, n, SLICE):
        upto = min(n, at + SLICE)
        low = sliding_min(gram_hashes(buffer[at : upto + window - 1], gram), window - gram + 1)
        change = np.flatnonzero(low[1:] != low[:-1]) + 1
        if before is None or low[0] != before:
            change = np.concatenate(([0], change))
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, upto)] - at  # a text's first window begins a run
        last = offsets[1:] - (window - 1)  # and its last ends one
        stop = last[(last >= at) & (last < upto)] - at
        change = np.union1d(np.union1d(change, cut), stop).astype(np.int64)
        names.append(low[change])
        starts.append(change + at)
        before = low[-1]
    name, start = np.concatenate(names), np.concatenate(starts)
    count = np.diff(np.concatenate((start, [n])))
    text = np.searchsorted(offsets, start, side="right") - 1
    fits = start + window <= offsets[text + 1]
    name, start, count = name[fits], start[fits], count[fits]
    return name, start, count, _named_twice(buffer, name, start, count, window, gram)


def _named_twice(buffer: np.ndarray, name: np.ndarray, start: np.ndarray, count: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The first place of the named string in a run's first window differs from its last place in the last window."""
    out, width, step = np.empty(len(name), bool), window - gram + 1, 1 << 13
    for i in range(0, len(name), step):
        s, c, k = start[i : i + step], count[i : i + step], name[i : i + step, None]
        base = s[0]
        h = gram_hashes(buffer[base : s[-1] + c[-1] + window - 1], gram)
        frames = np.lib.stride_tricks.sliding_window_view(h, width)
        first = s + (frames[s - base] == k).argmax(1)
        last = s + c - 1 + width - 1 - (frames[s + c - 1 - base, ::-1] == k).argmax(1)
        out[i : i + step] = first != last
    return out


#: Symbols of a text that go into one number: a byte and one, or 0 behind the end.
PACK = 7


def suffix_array(buffer: np.ndarray, ends: np.ndarray, cap: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lengths shared with the suffix before) of texts laid end to end, by prefix doubling.

    ``ends``: for each position, the end of its text; no suffix goes beyond it.  Shared lengths above ``cap`` are
    given as ``cap``; suffixes that share so much are in no defined order.  Those under ``least`` may be given as 0.
    """
    n = len(buffer)
    where = np.arange(n)
    left = ends - where
    pack = np.zeros(n, np.int64)
    for k in range(PACK):
        at = np.minimum(where + k, n - 1)
        pack = (pack << 9) | np.where(k < left, buffer[at].astype(np.int64) + 1, 0)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([1], (s[1:] != s[:-1]).cumsum() + 1))
        return order, rank

    order, rank = ranked(pack)
    have, levels = PACK, [(PACK, rank)]
    while have < cap and rank.max() < n:
        ahead = where + have
        second = np.where(ahead < ends, rank[np.minimum(ahead, n - 1)], 0)
        order, rank = ranked(rank * (n + 1) + second)
        have *= 2
        levels.append((have, rank))
    pairs = np.flatnonzero(np.minimum(left[order[:-1]], left[order[1:]]) >= least)
    for length, rank in reversed(levels):
        if length <= least:  # who differs here can't reach the least
            pairs = pairs[rank[order[pairs]] == rank[order[pairs + 1]]]
            break
    a, b = order[pairs], order[pairs + 1]
    shared = np.zeros(len(pairs), np.int64)
    most = np.minimum(left[a], left[b])
    for length, rank in reversed(levels):
        if length > cap:
            same = np.flatnonzero(rank[a] == rank[b])
            shared[same] = length
            continue
        x, y = a + shared, b + shared
        ok = np.flatnonzero((shared < most) & (shared < cap))
        ok = ok[rank[x[ok]] == rank[y[ok]]]
        shared[ok] += length
    ok = np.flatnonzero((shared < most) & (shared < cap))
    for k in range(PACK - 1):  # the last few symbols
        x, y = a[ok] + shared[ok], b[ok] + shared[ok]
        ok = ok[shared[ok] < most[ok]]
        x, y = a[ok] + shared[ok], b[ok] + shared[ok]
        ok = ok[buffer[x] == buffer[y]]
        shared[ok] += 1
    out = np.zeros(n, np.int64)
    out[pairs + 1] = np.minimum(np.minimum(shared, most), cap)
    return order, out


def suffixes(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, cap: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_array`` of texts of which some may be equal: those are sorted once, and each suffix stands beside its twins."""
    at, raw, first = np.flatnonzero(begins == np.arange(len(buffer))), buffer.tobytes(), {}
    size = ends[at] - at
    which = np.array([first.setdefault(raw[s:e], len(first)) for s, e in zip(at.tolist(), ends[at].tolist())])
    if len(first) == len(at):
        return suffix_array(buffer, ends, cap, least)
    members = np.argsort(which, kind="stable")
    copies = np.bincount(which)
    begin = copies.cumsum() - copies  # in ``members``
    length = size[members[begin]]
    base = length.cumsum() - length
    order, shared = suffix_array(np.frombuffer(b"".join(first), np.uint8), np.repeat(base + length, length), cap, least)
    text = np.repeat(np.arange(len(length)), length)[order]
    times = copies[text]
    nth = np.arange(times.sum()) - np.repeat(times.cumsum() - times, times)
    text, offset = np.repeat(text, times), np.repeat(order - base[text], times)
    return at[members[begin[text] + nth]] + offset, np.where(nth == 0, np.repeat(shared, times), np.minimum(length[text] - offset, cap))


def repeat_nodes(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the maximal repeats of at least ``least`` bytes as (first, last, length) of its parts.

    The interval tree of common prefixes is read off the suffix array with a stack.  A node is a maximal repeat if its
    occurrences have different bytes to their left; one that begins a text counts as different.  Repeats of ``cap``
    and more come as overlapping ones of ``cap``.  ``begins``, ``ends``: of the text of each position.
    """
    none = np.empty((3, 0), np.int64)
    if len(buffer) < 2:
        return np.arange(len(buffer)), none
    order, shared = suffixes(buffer, begins, ends, cap, least)
    deep = shared >= least
    edge = np.diff(np.concatenate(([0], deep.view(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1) - 1, np.flatnonzero(edge == -1) - 1  # first and last suffix of each top node
    if not len(lo):
        return order, none
    before = np.where(order == begins[order], -1 - order, buffer[np.maximum(order - 1, 0)].astype(np.int64))
    mixed = np.concatenate(([0], (before[1:] != before[:-1]).cumsum()))
    full = np.concatenate(([0], (shared >= cap).cumsum()))
    keep = (mixed[lo] != mixed[hi]) | (full[hi + 1] > full[lo + 1])  # else no node below is a maximal repeat either
    lo, hi = lo[keep], hi[keep]
    pair = hi == lo + 1
    nodes = [np.stack((lo[pair], hi[pair], shared[hi[pair]]))]
    found: list[tuple[int, int, int]] = []
    for i, j in zip(lo[~pair].tolist(), hi[~pair].tolist()):
        lengths, left = shared[i + 1 : j + 1].tolist(), mixed[i : j + 1].tolist()
        stack: list[tuple[int, int]] = []  # (length, first suffix) of the open nodes
        for k, length in enumerate([*lengths, 0]):
            first = k
            while stack and stack[-1][0] >= length:
                deep_length, first = stack.pop()
                if deep_length > length and (left[first] != left[k] or deep_length >= cap):
                    found.append((i + first, i + k, deep_length))
            if length:
                stack.append((length, first))
    if found:
        nodes.append(np.array(found).T)
    return order, np.concatenate(nodes, axis=1)


def maximal_repeats(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeat, length, position): all occurrences of the maximal repeats of ``repeat_nodes``."""
    order, (lo, hi, length) = repeat_nodes(buffer, begins, ends, least, cap)
    size = hi - lo + 1
    which = np.repeat(np.arange(len(lo)), size)
    at = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + lo[which]
    return which, length[which], order[at]


def later_repeats(buffer: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, length): for each position the longest maximal repeat that isn't the first of its occurrences there.

    Nested repeats have the same occurrences many times over, so they aren't listed.
    """
    order, nodes = repeat_nodes(buffer, begins, ends, least, cap)
    longest = np.zeros(len(order), np.int64)
    pair = nodes[1] == nodes[0] + 1
    lo, hi, length = nodes[:, pair]
    np.maximum.at(longest, np.where(order[lo] > order[hi], lo, hi), length)
    for i, j, n in nodes[:, ~pair].T.tolist():
        part = longest[i : j + 1]
        first = int(order[i : j + 1].argmin())
        own = part[first]
        np.maximum(part, n, out=part)
        part[first] = own
    at = np.flatnonzero(longest)
    return order[at], longest[at]
