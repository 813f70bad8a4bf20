"""Clustering of integer vectors around centroids, with a vantage-point tree over the centroids.

Every round builds the tree anew and broadcasts it; its size is the number of centroids times the dimension, whatever
the number of vectors.  A vector looks its centroid up best-first: of its open nodes the one with the smallest lower
bound is next, until that bound exceeds the best distance found; a bound equal to it is still visited, so that ties go
to the smaller number.  All vectors of an Arrow batch take their steps together, each with its own queue.

Nothing is rounded: distances are integers, bounds are integer roots rounded the safe way, sums of a round travel as
limbs of integers of any size.  A round reads the vectors once and shuffles one sum for each task, centroid and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, table

DIM, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
#: Centroids in a leaf of the tree at most.
LEAF = 2
#: Rows times nodes that are searched at a time.
CELLS = 1 << 22
#: Bits of a limb of a sum.
LIMB = 40
LONGEST = 2**63 - 1


def kept_vectors(rows: DataFrame, dim: int = DIM, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector has ``dim`` components, none of them null or non-finite."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return picked.where(F.col("v").isNotNull() & (F.size("v") == dim) & ~odd)


def floored(x: float, scale: int) -> int:
    """floor(scale * x) of a double, the product taken in doubles where it is one."""
    product = x * scale
    return math.floor(product) if math.isfinite(product) else int(x) * scale


def small(dim: int) -> int:
    """Components up to this size give distances that fit 62 bits."""
    return math.isqrt((1 << 62) // max(dim, 1)) // 2


def split_matrices(x: np.ndarray, scale: int, all_large: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integers): those with small components as int64, others as Python integers."""
    large = np.full(len(x), all_large) | (np.abs(x) * scale >= small(x.shape[1])).any(1)
    out = []
    if len(i := np.flatnonzero(~large)):
        out.append((i, np.floor(x[i] * scale).astype(np.int64)))
    if len(i := np.flatnonzero(large)):
        exact = np.empty((len(i), x.shape[1]), object)
        exact[:] = [[floored(v, scale) for v in row] for row in x[i].tolist()]
        out.append((i, exact))
    return out


class VantageTree:
    """A tree over centroids: an inner node has a vantage centroid and a near and a far half of the others."""

    def __init__(self, centroids: list[list[int]], leaf: int = LEAF):
        self.centroids = centroids
        self.dim = len(centroids[0])
        self.large = any(abs(x) >= small(self.dim) for c in centroids for x in c)
        self.nodes: list[tuple] = []
        self._build(list(range(len(centroids))), leaf)

    def _square(self, a: int, b: int) -> int:
        return sum((x - y) ** 2 for x, y in zip(self.centroids[a], self.centroids[b]))

    def _build(self, members: list[int], leaf: int) -> int:
        """Number of the new node; nodes are (members,) or (vantage, [(child, least root, greatest root), ...])."""
        me = len(self.nodes)
        self.nodes.append((members,))
        if len(members) > max(leaf, 1):
            vantage = max(members, key=lambda c: (self._square(members[0], c), -c))
            others = sorted((self._square(vantage, c), c) for c in members if c != vantage)
            halves = [h for h in (others[: len(others) // 2], others[len(others) // 2 :]) if h]
            self.nodes[me] = (vantage, [(self._build([c for _, c in h], leaf), math.isqrt(h[0][0]), math.isqrt(h[-1][0]) + 1) for h in halves])
        return me

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each row of integers; ties go to the smaller number."""
        step = max(1, CELLS // len(self.nodes))
        found = [self._nearest(x[at : at + step]) for at in range(0, max(len(x), 1), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        exact = x.dtype == object
        centres = np.array(self.centroids, dtype=x.dtype)
        far = float("inf") if exact else math.isqrt(LONGEST)  # a bound that no distance reaches
        best = np.full(len(x), float("inf") if exact else LONGEST, x.dtype)
        who = np.full(len(x), len(centres))
        low = np.full((len(x), len(self.nodes)), far, x.dtype)  # lower bounds of open nodes' distances
        low[:, 0] = 0
        root = np.frompyfunc(math.isqrt, 1, 1) if exact else lambda d: np.sqrt(d.astype(np.float64)).astype(np.int64)

        def measure(rows: np.ndarray, c: int) -> np.ndarray:
            apart = x[rows] - centres[c]
            d = (apart * apart).sum(1)
            better = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
            best[rows[better]], who[rows[better]] = d[better], c
            return d

        active = np.arange(len(x))
        while len(active):
            node = low[active].argmin(1)
            bound = low[active, node]
            go = (bound < far) & (bound * bound <= best[active])
            active, node, bound = active[go], node[go], bound[go]
            low[active, node] = far
            for k in np.unique(node):
                rows, above = active[node == k], bound[node == k]
                if len(self.nodes[k]) == 1:
                    for c in self.nodes[k][0]:
                        measure(rows, c)
                    continue
                r = root(measure(rows, self.nodes[k][0]))  # within one of the true root
                for child, least, most in self.nodes[k][1]:
                    low[rows, child] = np.maximum(above, np.maximum(r - 1 - most, least - (r + 2)))
        return who, best


def limbs(value: int) -> list[tuple[int, int]]:
    """(number, limb) of an integer of any size, its sign on each limb; none for zero."""
    sign, value, out, i = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if part := value & ((1 << LIMB) - 1):
            out.append((i, sign * part))
        value, i = value >> LIMB, i + 1
    return out


def _searched(b: pa.RecordBatch, column: int, tree: VantageTree, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, centroids, distances) of a batch, in one or two portions."""
    if b.num_rows:
        x = b.column(column).flatten().to_numpy().reshape(b.num_rows, -1)
        for rows, ints in split_matrices(x, scale, tree.large):
            yield rows, ints, *tree.nearest(ints)


def _sums(vectors: DataFrame, tree: VantageTree, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid that has any."""
    context = vectors.sparkSession.sparkContext
    sent = context.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        totals: dict[int, list[int]] = {}
        for b in batches:
            for _, ints, who, _ in _searched(b, 0, known, scale):
                for c in np.unique(who).tolist():
                    mine = ints[who == c]
                    add = [len(mine), *map(int, mine.sum(0))]
                    totals[c] = [p + q for p, q in zip(totals[c], add)] if c in totals else add
        rows = [(c, j, i, part) for c, total in totals.items() for j, value in enumerate(total) for i, part in limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, [pa.int32()] * 3 + [pa.int64()])], ["c", "j", "i", "part"])

    parts = vectors.select("v").mapInArrow(run, "c int, j int, i int, part long")
    totals: dict[int, list[int]] = {}
    for r in parts.groupBy("c", "j", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect():  # centroids x components
        totals.setdefault(r.c, [0] * (tree.dim + 1))[r.j] += int(r.part) << LIMB * r.i
    sent.destroy()
    return {c: (t[0], t[1:]) for c, t in totals.items()}


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> list[list[int]]:
    """Centroids after ``rounds`` rounds, or fewer if none moves any more; ``vectors``: of ``kept_vectors``, written.

    They start as the k vectors whose sha256 of ``salt`` and id is smallest; of rows with equal ids the smaller vector
    comes first, rows without an id come last.  Fewer vectors give fewer centroids.
    """
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    now = [[floored(x, scale) for x in r.v] for r in first]
    for _ in range(rounds if now else 0):
        sums = _sums(vectors, VantageTree(now), scale)
        new = [[t // sums[c][0] for t in sums[c][1]] if c in sums else now[c] for c in range(len(now))]
        if new == now:
            break
        now = new
    return now


def assign(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance): each vector's nearest centroid; distances beyond a long are null."""
    sent = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, object)
            for rows, _, who, d in _searched(b, 1, sent.value, scale):
                cluster[rows], distance[rows] = who, d
            fits = [int(d) if d <= LONGEST else None for d in distance]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = SALT, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Left out: null vectors, vectors of another length, those with a null or non-finite component.  Repeated rows each
    count and have a row each; a null id stays null.  Components of any finite size are exact; what exceeds a long
    (a distance, or a sum with such a distance) is null.  Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    vectors = materialise(kept_vectors(rows, dim, vec_col, id_col), "vectors")
    centroids = fit(vectors, k, rounds, scale, salt)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    assigned = materialise(assign(vectors, centroids, scale), "assigned")
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(total.alias("total")).collect()}  # one for each centroid
    fits = lambda x: int(x) if x is not None and x <= LONGEST else None
    whole = fits(None if None in sums.values() else sum(sums.values()))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(t), whole, sha[c]) for c, t in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 8 clusters after 10 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle(rounds: int = ROUNDS, k: int = CENTROIDS) -> str:
    """Every round as two tables: assignments and centroids.  Doubles hold all its sums exactly on the given tables."""
    assigned = """SELECT rid, vec_id, k.v, c, (list_inner_product(k.v, k.v) + list_inner_product(m.v, m.v) - 2 * list_inner_product(k.v, m.v))::BIGINT AS d
      FROM kept k, {0} m QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1"""
    moved = """SELECT o.c, coalesce(n.v, o.v) AS v FROM {0} o LEFT JOIN (
      SELECT c, list(floor(s / n) ORDER BY j) AS v FROM (
        SELECT c, j, sum(x)::DOUBLE AS s, count(*) AS n FROM (SELECT c, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM {1}) GROUP BY c, j) GROUP BY c) n ON n.c = o.c"""
    steps = "".join(f", a{i} AS MATERIALIZED ({assigned.format(f'c{i}')}), c{i + 1} AS MATERIALIZED ({moved.format(f'c{i}', f'a{i}')})\n" for i in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})
) {steps}, last AS ({assigned.format(f"c{rounds}")})
SELECT vec_id, l.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY l.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM last l JOIN c{rounds} m ON m.c = l.c
"""


ORACLE = _oracle()
