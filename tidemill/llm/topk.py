"""Exact top-k inner products by a pivot-distance index.

Vectors become integers first.  With M the largest length, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products are the nearest neighbours.  Every row is keyed by its
nearest pivot and its distance from it.  Rows of a pivot are cut into rings (annuli) of about ``CHUNK`` rows; a ring
of more, such as one of many equal vectors, is dealt out to several chunks.

A query first searches the chunk that it lies in, which gives a k-th score that the result can't fall below.  Then its
rings are sorted by the best score that the triangle inequality allows them: no row of a ring at distances lo..hi from
a pivot is nearer to q' than the gap between lo..hi and q's own distance from that pivot.  It visits them outward in
rounds, the nearest first, then ``GROWTH`` times as many; after each round its k-th score rises, and it stops at the
first ring that can't reach it.  Queries travel to chunks in packs, so nothing is broadcast but pivots and ring limits,
whose numbers are fixed.

Products of rows with components so large that doubles can't hold them exactly are taken with Python's integers, these
rows against all queries and such queries against all rows, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.centroids import floored
from tidemill.llm.common import materialise, partitions, table

PIVOTS = 64
#: Rows that the pivots are fitted on at most: those whose hashed vec_id is smallest.
SAMPLE = 4000
#: Rows of a ring or chunk, about.
CHUNK = 4096
#: Steps of distance that rings are made of.
STEPS = 1024
#: Queries in a pack at most.
PACK = 1024


#: By how much a round's number of rings grows.
GROWTH = 8
#: Squared lengths, reckoned upwards, below which all products and their partial sums are exact in doubles.
EXACT = 2.0**52
LONGEST = 2**63 - 1


def kept_rows(rows: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """(rid, vec_id, e, large): a number for each row, its components as doubles, whether products need large integers.

    Rows with a null id or vector, or with a null or non-finite component, are left out; repeated rows and ids stay.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = picked.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & ~odd)
    upwards = F.aggregate("e", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    return whole.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "e", (upwards >= EXACT).alias("large"))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    ends = lists.offsets.to_numpy()
    size = np.diff(ends)
    values = lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(ends[:-1] - ends[0], size)] = values[ends[0] : ends[-1]]
    return out


class Space:
    """Pivots in the space of x', and the largest squared length of a vector."""

    def __init__(self, sample: np.ndarray, most: float, n_pivots: int, rounds: int = 8):
        self.most, self.dim = most, sample.shape[1]
        x = self.lift(sample)
        self.pivots = x[np.linspace(0, len(x) - 1, min(n_pivots, len(x))).astype(int)]
        for _ in range(rounds):
            near = self.distances(x).argmin(1)
            for p in set(near.tolist()):
                self.pivots[p] = x[near == p].mean(0)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0, self.most - (x * x).sum(1)))[:, None]), axis=1)

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(0, square))

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1))


class Rings:
    """Limits of rings, in order of pivot and distance, and how many chunks each is dealt out to."""

    def __init__(self, counts: dict[tuple[int, int], int], width: float, n_pivots: int, chunk: int):
        self.width = width
        self.pivot, self.lo, self.hi, rows = [], [], [], []
        self.of = np.zeros((n_pivots, STEPS), np.int64)
        for p, s in sorted(counts):
            n = counts[p, s]
            if not self.pivot or self.pivot[-1] != p or rows[-1] + n > chunk:
                self.pivot.append(p)
                self.lo.append(s * width)
                self.hi.append(s * width)
                rows.append(0)
            rows[-1] += n
            self.hi[-1] = (s + 1) * width
            self.of[p, s] = len(rows) - 1
        self.pivot, self.lo, self.hi = np.array(self.pivot, int), np.array(self.lo), np.array(self.hi)
        self.chunks = -(-np.array(rows, int) // chunk)
        self.base = np.concatenate(([0], self.chunks.cumsum()))

    def of_chunk(self, chunk: int) -> int:
        """The ring that a chunk belongs to."""
        return int(np.searchsorted(self.base, chunk, side="right")) - 1

    def step(self, r: np.ndarray) -> np.ndarray:
        return np.minimum(STEPS - 1, (r / self.width).astype(np.int64))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, by score and then the smaller id; rows that score -inf take no part."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        i = np.flatnonzero(scores >= kth)
    else:
        i = np.arange(len(scores))
    i = i[scores[i] > -np.inf]
    return i[np.lexsort((ids[i], -scores[i]))[:k]]


def _indexed(vectors: DataFrame, space: Space, chunk: int) -> tuple[DataFrame, Rings]:
    """Chunks (chunk, rows of (r, vec_id, rid, v)) of (vec_id, v, rid), and their rings."""
    radius = 2 * np.sqrt(space.most) + 1.0
    width, dim = radius / STEPS, space.dim

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = space.distances(space.lift(_matrix(b.column(1), dim)))
            near = d.argmin(1)
            cols = [b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "rid", "pivot", "r"])

    placed = vectors.select("vec_id", "v", "rid").mapInArrow(place, "vec_id long, v array<double>, rid long, pivot int, r double")
    step = F.least(F.lit(STEPS - 1), F.floor(F.col("r") / width)).cast("int")
    counts = {(r.pivot, r.step): r["count"] for r in placed.groupBy("pivot", step.alias("step")).count().collect()}  # at most PIVOTS * STEPS
    rings = Rings(counts, width, len(space.pivots), chunk)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ring = rings.of[b.column(3).to_numpy(), rings.step(b.column(4).to_numpy())]
            salt = b.column(5).to_numpy() % rings.chunks[ring]
            cols = [pa.array(rings.base[ring] + salt, pa.int64()), b.column(0), b.column(2), b.column(1), b.column(4)]
            yield pa.RecordBatch.from_arrays(cols, ["chunk", "vec_id", "rid", "v", "r"])

    salted = placed.withColumn("salt", F.xxhash64("rid").bitwiseAND(F.lit(0x7FFFFFFF)))
    dealt = salted.mapInArrow(deal, "chunk long, vec_id long, rid long, v array<double>, r double")
    chunks = dealt.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "rid", "v"))).alias("rows"))  # about CHUNK rows each
    return materialise(chunks, "chunks"), rings


def _members(rows: pa.ListArray, i: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distances, vec_ids, row numbers, vectors) of the i-th chunk."""
    part = rows[i].values
    return part.field(0).to_numpy(), part.field(1).to_numpy(), part.field(2).to_numpy(), _matrix(part.field(3), dim)


FOUND = "rid long, query_id long, vec_id long, score long"


def _top(found: DataFrame, k: int, by: str = "score") -> DataFrame:
    """``found`` with the rank of each row among its query's, up to k."""
    order = Window.partitionBy("rid").orderBy(F.desc(by), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _indexed_search(vectors: DataFrame, k: int, every: int, n_pivots: int, chunk: int) -> DataFrame:
    """FOUND of queries among (rid, vec_id, v), for vectors whose products doubles hold exactly."""
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.max(square).alias("most"), F.max(F.size("v")).alias("dim")).first()
    if facts.dim is None:
        return spark.createDataFrame([], FOUND)
    dim = max(1, facts.dim)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    sample = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        sample[i, : len(r.v)] = r.v
    space = Space(sample, facts.most, n_pivots)
    chunks, rings = _indexed(vectors, space, chunk)
    n, n_rings = partitions(spark), len(rings.pivot)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a chunk with the k-th best score within it."""
        for b in batches:
            rids, ids, vs, least = [], [], [], []
            for i in range(b.num_rows):
                _, mine, rid, x = _members(b.column(1), i, dim)
                for j in np.flatnonzero(mine % every == 0):
                    s = x @ x[j]
                    s[j] = -np.inf
                    rids.append(rid[j])
                    ids.append(mine[j])
                    vs.append(x[j])
                    least.append(np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf)
            cols = [pa.array(rids, pa.int64()), pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.float64())), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "query_id", "q", "least"])

    def visits(first: int, last: int):
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Packs of queries for each chunk of their rings number ``first`` to ``last``, as far as these can hold a score of ``least`` or more."""
            for whole in batches:
                for at in range(0, whole.num_rows, PACK):
                    b = whole.slice(at, PACK)
                    rids, ids, least, q = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(2), dim)
                    d = space.query_distances(q)[:, rings.pivot]
                    gap = np.maximum(0, np.maximum(rings.lo[None] - d, d - rings.hi[None]) - 1e-6 * (1 + d))
                    most = ((q * q).sum(1)[:, None] + space.most - gap * gap) / 2
                    most += 1e-6 * (1 + np.abs(most))
                    turn = np.empty(most.shape, np.int64)
                    np.put_along_axis(turn, (-most).argsort(1, kind="stable"), np.arange(n_rings)[None].repeat(len(q), 0), 1)
                    wanted = (turn >= first) & (turn < last) & (most >= least[:, None])
                    out: list[list] = [[] for _ in range(5)]
                    for ring in np.flatnonzero(wanted.any(0)).tolist():
                        w = np.flatnonzero(wanted[:, ring])
                        pack = [x[w].astype(t).tobytes() for x, t in ((rids, "<i8"), (ids, "<i8"), (q, "<f8"), (least, "<f8"))]
                        for c in range(rings.base[ring], rings.base[ring + 1]):
                            for col, v in zip(out, (c, *pack)):
                                col.append(v)
                    kinds = [pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["chunk", "rids", "ids", "qs", "least"])

        return visit

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of each query within a chunk, among those that reach ``least``."""
        for b in batches:
            out: list[np.ndarray] = []
            for i in range(b.num_rows):
                r, mine, rid, x = _members(b.column(4), i, dim)
                rids, ids, least = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((0, "<i8"), (1, "<i8"), (3, "<f8")))
                q = np.frombuffer(b.column(2)[i].as_py(), "<f8").reshape(-1, dim)
                d = space.query_distances(q)[:, rings.pivot[rings.of_chunk(b.column(5)[i].as_py())]]
                reach = np.sqrt(np.maximum(0, (q * q).sum(1) + space.most - 2 * least)) + 1e-3  # farther rows score less
                lo, hi = np.searchsorted(r, d - reach), np.searchsorted(r, d + reach, side="right")
                for j in range(len(ids)):
                    s = x[lo[j] : hi[j]] @ q[j]
                    s[rid[lo[j] : hi[j]] == rids[j]] = -np.inf
                    s[s < least[j]] = -np.inf
                    own = mine[lo[j] : hi[j]]
                    best = _best(s, own, k)
                    out.append(np.stack((np.full(len(best), rids[j]), np.full(len(best), ids[j]), own[best], s[best].astype(np.int64))))
            got = np.concatenate(out, axis=1) if out else np.empty((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["rid", "query_id", "vec_id", "score"])

    queries = materialise(chunks.mapInArrow(seed, "rid long, query_id long, q array<double>, least double"), "queries")
    found, first, width = None, 0, 1
    while first < n_rings:
        packs = queries.mapInArrow(visits(first, first + width), "chunk long, rids binary, ids binary, qs binary, least binary")
        met = packs.repartition(n, "chunk").join(chunks.hint("merge"), "chunk").select("rids", "ids", "qs", "least", "rows", "chunk")
        more = met.mapInArrow(search, FOUND)
        found = materialise(_top(more if found is None else more.unionByName(found), k).drop("rank"), "found")
        first, width = first + width, width * GROWTH
        if first < n_rings:
            kth = found.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select("rid", "kth")
            tightened = queries.join(kth, "rid", "left").select("rid", "query_id", "q", F.greatest("least", F.col("kth").cast("double")).alias("least"))
            queries = materialise(tightened, "queries")
    return found


def order_key(value: int) -> bytes:
    """Bytes that sort as the integers do, of any size."""
    size = (abs(value).bit_length() + 7) // 8
    plain = size.to_bytes(4, "big") + abs(value).to_bytes(size, "big")
    return b"\1" + plain if value >= 0 else b"\0" + bytes(255 - x for x in plain)


def _large_search(rows: DataFrame, k: int, every: int, chunk: int, scale: int) -> DataFrame:
    """FOUND and ``key`` of all pairs of a query and a row of which either is large; rows: of ``kept_rows``, written.

    Each query meets all large rows, each large query all others, in blocks of ``chunk`` rows.  A score beyond a long is null.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    count = {r.large: r["count"] for r in rows.groupBy("large").count().collect()}  # two rows
    blocks = {large: -(-count.get(large, 0) // chunk) for large in (False, True)}
    numbered = F.when(F.col("large"), F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks[True])))).otherwise(F.pmod(F.xxhash64("rid"), F.lit(max(1, blocks[False]))) + blocks[True])
    held = rows.withColumn("block", numbered).groupBy("block").agg(F.collect_list(F.struct("rid", "vec_id", "e")).alias("rows"))  # about ``chunk`` rows each
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("pack", F.floor(F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(1 << 30)) * max(1, sum(count.values()) // (every * PACK)) / (1 << 30)))
    packs = asked.groupBy("pack", "large").agg(F.collect_list(F.struct("rid", "vec_id", "e")).alias("asked"))
    last = F.when(F.col("large"), sum(blocks.values()) - 1).otherwise(blocks[True] - 1)
    met = packs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long")))).repartition(n, "block").join(held, "block").select("asked", "rows")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda e: [floored(x, scale) for x in e]
        for b in batches:
            for asked, rows in zip(b.column(0), b.column(1)):
                theirs = [(r["rid"], r["vec_id"], whole(r["e"])) for r in rows.as_py()]
                out = []
                for q in asked.as_py():
                    mine = whole(q["e"])
                    scores = [(-sum(x * y for x, y in zip(mine, v)), i) for rid, i, v in theirs if rid != q["rid"]]
                    out += [(q["rid"], q["vec_id"], i, -s if abs(s) <= LONGEST else None, order_key(-s)) for s, i in heapq.nsmallest(k, scores)]
                cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [*[pa.int64()] * 4, pa.binary()])]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "query_id", "vec_id", "score", "key"])

    return met.mapInArrow(search, FOUND + ", key binary")


def _keyed(found: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([order_key(s) for s in b.column(3).to_pylist()], pa.binary())], ["rid", "query_id", "vec_id", "score", "key"])

    return found.select("rid", "query_id", "vec_id", "score").mapInArrow(run, FOUND + ", key binary")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, n_pivots: int = PIVOTS, chunk: int = CHUNK, vec_col: str = "embedding", id_col: str = "vec_id", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` the k best among all other rows.

    Ties go to the smaller vec_id; with fewer than k other rows all are returned.  Rows with equal ids are rows like
    others: each is a candidate, also for one another, and each is a query if its id says so.  Rows with a null id or
    vector, or with a null or non-finite component, take no part.  Vectors of different lengths are taken as filled up
    with zeros.  Components may be of any finite size; a score beyond a long ranks as it should and is shown as null.
    Other columns are not read; an empty table gives no rows.
    """
    kept = materialise(kept_rows(rows, vec_col, id_col, scale), "rows")
    floors = F.transform("e", lambda x: F.floor(x * scale).cast("double"))
    found = _indexed_search(kept.where("not large").select("rid", "vec_id", floors.alias("v")), k, every, n_pivots, chunk)
    if not kept.where("large").limit(1).isEmpty():
        found = _top(_keyed(found).unionByName(_large_search(kept, k, every, chunk, scale)), k, "key")
    else:
        found = _top(found, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector among all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
