"""SimHash near-dedup: a byte-position inverted index with count filtering.

A fingerprint is eight bytes.  If two fingerprints differ in at most four bits, at most four bytes differ, so they
share at least four of eight *positional bytes*.  A posting list of one positional byte holds 1/256 of all
fingerprints and would make the tally quadratic; the index therefore posts *groups of three positions*, chosen such
that any four positions contain one of the groups.  Pairs that meet in a posting list have their shared positional
bytes tallied, those under four are dropped, the others are verified bit by bit.

A posting list with more than ``limit`` fingerprints is not cut: its entries are posted again under one more
position (four bytes), then under three of the other eight half-bytes, then a fourth.  Two fingerprints within four
bits share these too, so nothing is lost, and a list of the last level has at most 2**16 different fingerprints.

The near-copy stage (``one_of_each``) finds candidates by the same index with a wider net: fingerprints of 256 bits,
32 positional bytes, pairs of positions within six classes posted, shared bytes tallied, bits counted.  Any seven shared
bytes contain a posted pair; six, five and four do with a chance of 97, 87 and 66 %.  A candidate is no link yet:
the two texts are fetched and the exact Jaccard similarity of their shingles of five words decides.  Links that the net
misses, by chance or because a long list gives only nearest ones, are found by ``rest_candidates``, which is exact: two
similar texts share a shingle that is among the rarest of both, so they meet in the lists of these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, partitions, table
from tidemill.llm.components import connected_components
from tidemill.llm.repeats import _mix as mix

#: Most differing bits of a link; what follows relies on it.
MAX_BITS = 4


def covering_triples(n: int = 8) -> list[tuple[int, ...]]:
    """Triples of ``range(n)`` such that any four numbers contain one: three classes, two of one and one of the next."""
    kind = [i * 3 // n for i in range(n)]
    out = []
    for t in combinations(range(n), 3):
        k = [kind[i] for i in t]
        if len(set(k)) == 1 or any(k.count(c) == 2 and k.count((c + 1) % 3) == 1 for c in range(3)):
            out.append(t)
    return out


def shingle_hashes(text: bytes | None, k: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of ``k`` words in slices of 32,768; fewer words are one shingle, no words none."""
    words = (text or b"").lower().split()  # of bytes, both know ASCII only: A-Z, and \x20 \x09-\x0D
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(k, len(words))
    h = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    for at in range(0, n, 1 << 15):
        upto = min(n, at + (1 << 15))
        cut = zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())
        yield np.array([h(joined[s:e], seed) for s, e in cut], np.uint64)


def majority(slices: Iterable[np.ndarray], width: int = 1) -> bytes:
    """Eight bytes for each of ``width`` words, most significant first: bits that over half of the hashes have.

    The first eight bytes use the hashes; further ones use them mixed with their number.
    """
    ones, n = np.zeros(64 * width, np.int64), 0
    more = np.arange(1, width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for one in slices:
        n += len(one)
        hashes = one[:, None]
        if width > 1:
            hashes = np.concatenate((hashes, mix(hashes + more)), axis=1)
        for i in range(0, len(one), 1 << 12):
            raw = hashes[i : i + (1 << 12)].astype(">u8").view(np.uint8).reshape(-1, 8 * width)
            ones += np.unpackbits(raw, axis=1).sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint_bytes(text: bytes | None, k: int = 4, seed: int = 42, width: int = 1) -> bytes:
    """The fingerprint of a whole text; null or no words: zero bytes."""
    return majority(shingle_hashes(text, k, seed), width)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long.  Repeated rows stay repeated; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [int.from_bytes(fingerprint_bytes(t, k, seed), "big", signed=True) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _mask(positions: tuple[int, ...], width: int = 8) -> int:
    """Bits of some bytes (or half-bytes) of a fingerprint, as a signed long."""
    bits = sum(((1 << width) - 1) << (width * i) for i in positions)
    return bits - (1 << 64) if bits >> 63 else bits


def refinements(level: int) -> list[tuple[int, int]]:
    """(mask, finer mask) pairs: the groups of positions under which the entries of a long list are posted again.

    Level 0 posts everything (mask 0) under three bytes, level 1 adds a fourth, level 2 adds a covering triple of the
    eight other half-bytes (at most four of which differ), level 3 a fourth half-byte.
    """
    out = set()
    for t in covering_triples():
        if level == 0:
            out.add((0, _mask(t)))
        for p in (p for p in range(8) if p not in t and level):
            four = tuple(sorted(t + (p,)))
            half = [2 * i + h for i in range(8) if i not in four for h in (0, 1)]
            if level == 1:
                out.add((_mask(t), _mask(four)))
            for u in covering_triples() if level > 1 else []:
                deep = _mask(four) | _mask(tuple(half[i] for i in u), 4)
                if level == 2:
                    out.add((_mask(four), deep))
                else:
                    out |= {(deep, deep | _mask((half[q],), 4)) for q in range(8) if q not in u}
    return sorted(out)


def _linked_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of two arrays of fingerprints: where they share at least 4 positional bytes and differ in at most 4 bits."""
    diff = (x ^ y).reshape(-1)
    shared = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    out = shared >= 8 - MAX_BITS
    out[out] = np.bitwise_count(diff[out]) <= MAX_BITS
    return out


def _forest(x: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one list: at most len(x) - 1 links instead of all pairs."""
    left, src, dst = np.arange(len(x)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(x[i : i + 1], x[left])
            if hit.any():
                found = left[hit].tolist()
                queue += found
                src += [i] * len(found)
                dst += found
                left = left[~hit]
    return src, dst


def _by_list(solve: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], width: int = 1):
    """Rows (key, node, words of a fingerprint or other longs), sorted by key: ``solve`` gets whole lists.  Holds one list and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_n, held_x = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, width), np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            word = lambda i: b.column(2 + i).to_numpy(zero_copy_only=False).view(np.uint64)  # noqa: B023, E731
            held_k = np.concatenate((held_k, b.column(0).to_numpy(zero_copy_only=False)))
            held_n = np.concatenate((held_n, b.column(1).to_numpy(zero_copy_only=False)))
            held_x = np.concatenate((held_x, np.stack([word(i) for i in range(width)], axis=1)))
            done = int(np.searchsorted(held_k, held_k[-1]))
            if done:
                yield from solve(held_k[:done], held_n[:done], held_x[:done])
                held_k, held_n, held_x = held_k[done:], held_n[done:], held_x[done:]
        if len(held_k):
            yield from solve(held_k, held_n, held_x)

    return run


def _list_sizes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lists begin, and their sizes."""
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return edge, np.diff(np.concatenate((edge, [len(keys)])))


def _links(linked: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """The links of each list as a spanning forest of nodes.  ``linked``: for two arrays of fingerprints, which pairs are links."""

    def solve(keys: np.ndarray, node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge, size = _list_sizes(keys)
        small = np.repeat(size <= 8, size)
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, 8):  # short lists all at once
            i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
            i = i[linked(x[i], x[i + d])]
            src.append(node[i])
            dst.append(node[i + d])
        for e, n in zip(edge[size > 8].tolist(), size[size > 8].tolist()):
            a, b = _forest(x[e : e + n], linked)
            src.append(node[e : e + n][a])
            dst.append(node[e : e + n][b])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (src, dst)], ["src", "dst"])

    return _by_list(solve)


def fingerprint_links(nodes: DataFrame, limit: int = 4096) -> DataFrame:
    """(src, dst) of links that connect just what all links within four bits connect.

    ``nodes``: (node, fp), both different in each row.
    """
    spark, out = nodes.sparkSession, None
    n = partitions(spark)
    post = nodes.select(F.explode(F.array(*[F.lit(m) for _, m in refinements(0)])).alias("mask"), "node", "fp")
    for level in range(4):
        post = post.withColumn("key", F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))))
        hot = None
        if level < 3:
            hot = materialise(post.groupBy("key").count().where(F.col("count") > limit).select("key"), "hot-lists")
            hot = None if hot.isEmpty() else hot
        cold = post if hot is None else post.join(hot, "key", "left_anti")
        found = cold.select("key", "node", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(_linked_rows), "src long, dst long")
        found = materialise(found, "pairs")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            break
        finer = spark.createDataFrame(refinements(level + 1), "mask long, finer long")  # at most 7000 rows, a fixed number
        again = post.join(hot, "key", "left_semi").join(F.broadcast(finer), "mask")
        post = materialise(again.select(F.col("finer").alias("mask"), "node", "fp").distinct(), "postings")
    return out


#: The wider net: words of a shingle, 64-bit words of a fingerprint, least shared bytes and most differing bits of a candidate.
WIDE_K, WIDE, WIDE_SHARED, WIDE_BITS = 5, 4, 4, 56
#: A link of the near-copy stage: this share of the shingles of either text is in both (numerator, denominator).
SIMILAR = (4, 5)
_CLASSES = 6
#: Fingerprints that are compared at a time within a long list.
_TILE = 1024
#: Documents of the sample that tells frequent shingles, and the most of these that are told.
ORDER_SAMPLE, ORDER_SIZE = 10_000, 1 << 17
#: Words of 64 bits of the filter of ids that goes to all tasks, whatever the number of ids.
FILTER_WORDS = 1 << 17


def position_pairs(n: int = 8 * WIDE, classes: int = _CLASSES) -> list[tuple[int, int]]:
    """Pairs of positions of one class each: any ``classes`` + 1 positions contain such a pair."""
    return [(i, j) for i, j in combinations(range(n), 2) if i % classes == j % classes]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of wide fingerprints, or 999 where too few positional bytes or too many bits make them no candidates."""
    diff = x ^ y
    bits = np.bitwise_count(diff).sum(-1, dtype=np.int64)
    shared = (diff.view(np.uint8).reshape(*diff.shape[:-1], 8 * WIDE) == 0).sum(-1)
    return np.where((shared >= WIDE_SHARED) & (bits <= WIDE_BITS), bits, 999)


def _candidates(keys: np.ndarray, node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(src, dst, bits), src < dst: all candidates of a list of at most 8; of a longer one each node's nearest of every ``_TILE`` nodes before it."""
    edge, size = _list_sizes(keys)
    small = np.repeat(size <= 8, size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for d in range(1, 8):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        bits = _apart(x[i], x[i + d])
        i, bits = i[bits < 999], bits[bits < 999]
        out.append((node[i], node[i + d], bits))
    for e, n in zip(edge[size > 8].tolist(), size[size > 8].tolist()):
        for at in range(0, n, _TILE):
            mine = np.arange(e + at, e + min(n, at + _TILE))
            for first in range(0, at + 1, _TILE):
                theirs = np.arange(e + first, e + min(n, first + _TILE))
                for some in np.array_split(mine, max(1, len(mine) * len(theirs) >> 16)):  # bounded memory
                    bits = _apart(x[some][:, None], x[theirs][None])
                    bits[theirs[None] >= some[:, None]] = 999
                    best = bits.argmin(1)
                    least = bits[np.arange(len(some)), best]
                    hit = least < 999
                    out.append((node[theirs[best[hit]]], node[some[hit]], least[hit]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out)], ["src", "dst", "bits"])


def wide_candidates(nodes: DataFrame, limit: int = 1 << 14) -> DataFrame:
    """(src, dst, bits), src < dst, of candidate pairs between (node, w0..w3).

    Entries of lists over ``limit`` are posted again under each third position, then a fourth: pairs that share at
    least WIDE_SHARED bytes meet in one of these too, so nothing that the first level finds is lost.  A long list gives
    only nearest candidates; what these leave unlinked is up to ``rest_candidates``.
    """
    spark, out = nodes.sparkSession, None
    n, words = partitions(spark), [f"w{i}" for i in range(WIDE)]
    masks = {p: [_mask(tuple(i % 8 for i in p if i // 8 == w)) for w in range(WIDE)] for p in position_pairs()}
    grid = lambda ps: F.array(*(F.struct(*(F.lit(m).cast("long").alias(f"m{w}") for w, m in enumerate(masks[p]))) for p in ps))
    post = nodes.select("node", *words, F.explode(grid(sorted(masks))).alias("m"))
    for level in range(3):
        post = post.withColumn("key", F.xxhash64("m", *(F.col(w).bitwiseAND(F.col(f"m.m{i}")) for i, w in enumerate(words))))
        hot = None
        if level < 2:
            hot = materialise(post.groupBy("key").count().where(F.col("count") > limit).select("key"), "hot-lists")
            hot = None if hot.isEmpty() else hot
        cold = post if hot is None else post.join(hot, "key", "left_anti")
        dealt = cold.select("key", "node", *words).repartition(n, "key").sortWithinPartitions("key", "node")
        found = dealt.mapInArrow(_by_list(_candidates, WIDE), "src long, dst long, bits long")
        found = materialise(found.groupBy("src", "dst").agg(F.min("bits").alias("bits")), "candidates")
        out = found if out is None else out.unionByName(found)
        if hot is None:
            break
        single = F.array(*(F.struct(*(F.lit(_mask((p % 8,)) if p // 8 == w else 0).cast("long").alias(f"m{w}") for w in range(WIDE))) for p in range(8 * WIDE)))
        again = post.join(hot, "key", "left_semi").withColumn("x", F.explode(single))
        finer = F.struct(*(F.col(f"m.m{w}").bitwiseOR(F.col(f"x.m{w}")).alias(f"m{w}") for w in range(WIDE)))
        again = again.select("node", *words, "m", finer.alias("finer")).where("m <> finer")
        post = materialise(again.select("node", *words, F.col("finer").alias("m")).distinct(), "postings")
    return out


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and documents) of shingles that are in more than one document of a sample.  ``docs``: (doc_id, text).

    At most ORDER_SIZE, the most frequent, of about ORDER_SAMPLE documents, or all if there are fewer.  They set the order
    of shingles in ``rest_candidates``: what they miss costs time, never a pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_h = np.concatenate([np.empty(0, np.uint64), *(shingle_set(t.as_py()) for t in b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(all_h.view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, docs.count()))) < ORDER_SAMPLE)
    counts = some.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 1")
    top = counts.orderBy(F.desc("count"), "h").limit(ORDER_SIZE).collect()
    h, n = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    return np.sort(h), n[np.argsort(h)]


def rarest(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's different shingles, ordered by frequency and hash: so many that fewer than SIMILAR of all follow."""
    n = len(shingles)
    first = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1 if n else 0
    at = np.searchsorted(known, shingles)
    seen = known.take(at, mode="clip") == shingles if len(known) else np.zeros(n, bool)
    if seen.any():
        shingles = shingles[np.lexsort((shingles, np.where(seen, counts.take(at, mode="clip"), 0)))]
    return shingles[:first]


def _unlinked(keys: np.ndarray, node: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(src, dst), src < dst: all pairs of a list that may be similar and aren't in one class yet.

    ``x``: class, size of the text's set, and how many of the set come at this shingle or after it.  At the first shingle
    that two texts share, both sets have from there on all that they share; so a pair is dropped where that isn't enough.
    """
    edge, length = _list_sizes(keys)
    mixed = np.repeat(np.maximum.reduceat(x[:, 0], edge) != np.minimum.reduceat(x[:, 0], edge), length)
    keys, node, x = keys[mixed], node[mixed], x[mixed].view(np.int64)
    if not len(keys):
        return
    order = np.lexsort((x[:, 1], keys))
    keys, node, root, size, left = keys[order], node[order], *np.ascontiguousarray(x[order].T)
    share, whole = SIMILAR[0], sum(SIMILAR)
    may = lambda i, j: (whole * np.minimum(left[i], left[j]) >= share * (size[i] + size[j])) & (root[i] != root[j])

    def batch(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        a, b = node[i], node[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

    edge, length = _list_sizes(keys)
    small = np.repeat(length <= 8, length)
    for d in range(1, 8):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        i = i[may(i, i + d)]
        if len(i):
            yield batch(i, i + d)
    for e, n in zip(edge[length > 8].tolist(), length[length > 8].tolist()):
        every = np.arange(e, e + n)
        classes, of = np.unique(root[every], return_inverse=True)
        most = of == np.bincount(of).argmax()  # within the largest class there is nothing to do
        for mine, theirs in ((every[~most], every), (every[most], every[~most])):
            mine = mine[whole * left[mine] >= 2 * share * size[mine]]  # the smaller of a pair needs as much
            top = np.searchsorted(size[theirs], size[mine] * SIMILAR[1] // SIMILAR[0], "right")
            low = np.searchsorted(theirs, mine, "right")
            for at in range(0, len(mine), 64):
                some = mine[at : at + 64]
                for first in range(int(low[at]), int(top[at : at + 64].max()), 1 << 14):  # bounded memory
                    other = theirs[first : min(first + (1 << 14), int(top[at : at + 64].max()))]
                    hit = may(some[:, None], other[None]) & (other[None] > some[:, None])
                    i, j = np.nonzero(hit)
                    if len(i):
                        yield batch(some[i], other[j])


def rest_candidates(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst), src < dst: pairs of nodes of different classes, all similar ones among them.

    ``nodes``: (node, size, prefix), the size of a text's set of shingles and the ``rarest`` of it; ``roots``: (node, root)
    of the classes so far.  Without one of its ``rarest`` shared, too few of a text's shingles are left for a similar pair.
    """
    at = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", F.posexplode("prefix").alias("pos", "key"))
    post = at.select("key", "node", "root", "size", (F.col("size") - F.col("pos")).alias("left"))
    dealt = post.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_by_list(_unlinked, 3), "src long, dst long").distinct()


def shingle_set(text: bytes | None, k: int = WIDE_K) -> np.ndarray:
    """The different shingle hashes of a whole text, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, k)]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``SIMILAR`` or more; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def sketch(shingles: np.ndarray) -> bytes:
    """Of each residue of the shingles whether an odd number has it: a power of two of bits, at least two for each shingle."""
    bits = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches, the longer one folded: never more than there are shingles of one text only."""
    (a, n), (b, m) = ((int.from_bytes(t, "little"), len(t)) for t in sorted((x, y), key=len))
    while m > n:
        m //= 2
        b = b >> 8 * m ^ b & (1 << 8 * m) - 1
    return (a ^ b).bit_count()


def plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (src, dst, more longs) without those whose sketches show that they aren't similar.  ``nodes``: (node, size, sketch)."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = zip(*(b.column(len(names) + i).to_pylist() for i in range(4)))
            keep = [sum(SIMILAR) * differing(x, y) <= (SIMILAR[1] - SIMILAR[0]) * (n + m) for n, x, m, y in own]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in range(len(names))], names)

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sketch").alias(f"{c}_sketch"))
    both = pairs.join(side("dst"), "dst").join(side("src"), "src")
    return both.select(*names, "src_size", "src_sketch", "dst_size", "dst_sketch").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def flagged(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` and whether their ``column`` may be in that of ``ids``, as ``<column>_may``: false where it is not, seldom true there.

    The bits of the hashed ids go to all tasks, FILTER_WORDS at most; so large rows needn't be shuffled to be told from others.
    """
    at, word, bits = f"pmod(xxhash64(`{column}`), {64 * FILTER_WORDS})", f"{column}_word", f"{column}_bits"
    words = ids.groupBy(F.expr(f"{at} div 64").alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 64 as int)))").alias(bits))
    met = rows.withColumn(word, F.expr(f"{at} div 64")).join(F.broadcast(words), word, "left")
    may = F.expr(f"coalesce(shiftright(`{bits}`, cast({at} % 64 as int)) & 1 = 1, false)")
    return met.withColumn(f"{column}_may", may).drop(word, bits)


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst) of the pairs whose ``texts`` (node, text) are similar.  A pair carries its two texts, nothing more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            keep = []
            for src, one, other in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if src != last:
                    last, own = src, shingle_set(one.as_py())
                keep.append(similar(own, shingle_set(other.as_py())))
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["src", "dst"])

    to = pairs.select("src", "dst").join(texts.select(F.col("node").alias("dst"), F.col("text").alias("other")), "dst")
    both = to.join(texts.select(F.col("node").alias("src"), F.col("text").alias("one")), "src")  # a hot src is split by the adaptive planner
    return both.select("src", "dst", "one", "other").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, seed: int = 42, limit: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    Text null, empty or without words: fingerprint zero, linked like any other.  Equal texts share a fingerprint.
    Repeated doc_ids give repeated rows; a null doc_id keeps its row and counts for no minimum.  Columns other than
    the two named are ignored, whatever their names.  An empty table gives no rows.
    """
    fps = materialise(fingerprints(docs, text_col, id_col, k, seed), "fingerprints")
    # a fingerprint's node is its smallest doc_id, so that a root is a component's smallest doc_id and no join on roots is
    # needed; only where a fingerprint has no doc_id at all it is its own node, and classes meet by root
    low = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    if low.where("low is null").isEmpty():
        nodes = materialise(low.select(F.col("low").alias("node"), "fp"), "nodes")
        roots = connected_components(fingerprint_links(nodes, limit))
        named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    else:
        nodes = materialise(low.select(F.col("fp").alias("node"), "fp", "low"), "nodes")
        roots = connected_components(fingerprint_links(nodes.drop("low"), limit))
        rooted = nodes.join(roots, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
        named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_links(nodes: DataFrame, texts: DataFrame, limit: int = 1 << 14) -> DataFrame:
    """(node, root) of the classes that all similar texts make; roots have no row.

    ``nodes``: (node, w0..w3, size, prefix, sketch); ``texts``: (node, text), more than needed does no harm.  Pairs whose
    sketches rule out a link go first, so that no text is fetched for them.  Each node is then held against its nearest
    candidate alone.  Of the other candidates only those between two of the classes so made can change anything, and all of
    these are held against each other next.  Last come the pairs of ``rest_candidates`` between the classes made till
    then, without those decided before; so no similar pair is left out.
    """
    pairs = materialise(plausible(wide_candidates(nodes, limit), nodes), "plausible")

    def fetched(some: DataFrame) -> DataFrame:
        needed = materialise(some.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "needed")
        few = flagged(texts, needed, "node").where("node_may").drop("node_may")
        return materialise(few.join(needed, "node", "left_semi"), "candidate-texts")

    own = fetched(pairs)
    nearest = pairs.groupBy("dst").agg(F.min(F.struct("bits", "src")).alias("best")).select("dst", F.col("best.src").alias("src"))
    links = materialise(confirmed(nearest, own), "links")
    roots = connected_components(links)
    root_of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rest = pairs.join(nearest, ["src", "dst"], "left_anti").join(root_of("src"), "src", "left").join(root_of("dst"), "dst", "left")
    apart = rest.where("coalesce(src_root, src) <> coalesce(dst_root, dst)").select("src", "dst")
    second = materialise(confirmed(apart, own), "links")
    if not second.isEmpty():
        links = links.unionByName(second)
        roots = connected_components(links)
    missed = materialise(plausible(rest_candidates(nodes, roots).join(pairs, ["src", "dst"], "left_anti"), nodes), "rest")
    if missed.isEmpty():
        return roots
    third = materialise(confirmed(missed, fetched(missed)), "links")
    return roots if third.isEmpty() else connected_components(links.unionByName(third))


def wide_roots(rows: DataFrame, text_col: str = "text", id_col: str = "doc_id", limit: int = 1 << 14) -> DataFrame:
    """(doc_id): the smallest of each class of near copies.  ``rows``: ids must be different and not null.

    Texts with the same set of shingles fold first, however often a shingle occurs; those without words are one class.
    """
    words, more = [f"w{i}" for i in range(WIDE)], ["size", "prefix", "sketch"]
    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(picked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, same, sizes, firsts, sketches = [], [], [], [], []
            for t in b.column(1):
                slices = list(shingle_hashes(t.as_py(), WIDE_K))
                fps.append(majority(slices, WIDE))
                shingles = np.unique(np.concatenate([np.empty(0, np.uint64), *slices]))
                same.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                sizes.append(len(shingles))
                firsts.append(rarest(shingles, *sent.value))
                sketches.append(sketch(shingles))
            x = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, WIDE).view(np.int64)
            ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64)))
            columns = [b.column(0), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(WIDE)), pa.array(sizes, pa.int64()), prefix, pa.array(sketches, pa.binary()), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *words, *more, "same"])

    fps = picked.mapInArrow(run, "doc_id long, " + ", ".join(f"{w} long" for w in words) + ", size long, prefix array<long>, sketch binary, same binary")
    least = F.min(F.struct("doc_id", *words, *more)).alias("least")
    kept = [F.col("least.doc_id").alias("node"), *(f"least.{c}" for c in (*words, *more))]
    nodes = materialise(fps.groupBy("same").agg(least).select(*kept), "nodes")  # copies fold before the shuffle
    roots = similar_links(nodes, picked.select(F.col("doc_id").alias("node"), "text"), limit)
    return nodes.join(roots.select("node"), "node", "left_anti").select(F.col("node").alias("doc_id"))


def one_of_each(docs: DataFrame, limit: int = 1 << 14) -> DataFrame:
    """Rows of ``docs``, with all their columns, that have the smallest doc_id of their class of near copies.

    Near copies are linked by a Jaccard similarity of 0.8 or more of their sets of shingles of five words, which is
    exact.  Most links come from ``wide_candidates``, all others from ``rest_candidates``.  Classes are chains of such links.  If a
    doc_id is null or repeated, rows are told apart by (doc_id, text), null first, and the first of a class stays.
    Null texts and texts without words are one class; very long texts are read whole; an empty table gives no rows.
    """
    unclear = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    mark = "_row" + "_" * max(map(len, docs.columns))  # clashes with no column
    if unclear.isEmpty():
        numbered = docs.withColumn(mark, F.col("doc_id").cast("long"))
    else:
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_first(), "text")
        numbered = materialise(ordered.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    stay = wide_roots(numbered, "text", mark, limit).select(F.col("doc_id").alias(mark))
    gone = materialise(numbered.select(mark).join(stay, mark, "left_anti"), "gone")
    told = flagged(numbered, gone, mark)  # only rows that may go are shuffled
    left = told.where(f"not `{mark}_may`").unionByName(told.where(f"`{mark}_may`").join(gone, mark, "left_anti"))
    return left.drop(mark, f"{mark}_may")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-equal ``documents``: links at four or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
