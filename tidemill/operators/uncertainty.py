"""Resampling of whole daily horizons by weights of blocks: replicates drawn with replacement, or all blocks but one.

A replicate is a column of a small matrix, one weight for each block.  A task makes the matrix of an entity itself, from
the rule of ``draws``, so neither replicates nor weights are shuffled, and no row is copied for a replicate: within a
part of the range of scores, block sums are multiplied by the matrix and added up for all replicates at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the range of scores; a group's results travel as one vector for each part.
RANGES = 256
#: Rows times replicates that are multiplied at a time.
CELLS = 1 << 21


def draws(blocks: DataFrame, reps: int, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rep, block_no, mult): how often each block (numbered from 0 by ``block_no``) is drawn in each replicate.

    As many draws as blocks, with replacement.  A draw is 52 bits of the MD5 sum of seed, keys, replicate and draw,
    modulo the number of blocks: any engine gives the same draws, and they pass for independent ones.
    """
    spark = blocks.sparkSession
    n = blocks.groupBy(*keys).agg(F.count("*").alias("n"))
    rep = spark.range(reps).select(F.col("id").alias("rep"))
    each = n.join(F.broadcast(rep)).select(*keys, "rep", "n", F.explode(F.expr("sequence(0L, n - 1)")).alias("draw"))
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys), F.col("rep").cast("string"), F.col("draw").cast("string")).cast("binary"))
    x = F.conv(F.substring(mixed, 1, 13), 16, 10).cast("long")
    return each.withColumn("block_no", x % F.col("n")).groupBy(*keys, "rep", "block_no").agg(F.count("*").alias("mult"))


def number_blocks(rows: DataFrame, keys: Sequence[str], block: str = "anchor_pos") -> DataFrame:
    """(keys, block, block_no): the blocks of each key, numbered from 0 in order.  One row a day, so a window over them is small."""
    order = Window.partitionBy(*keys).orderBy(block)
    return rows.select(*keys, block).distinct().withColumn("block_no", (F.row_number().over(order) - 1).cast("long"))


@lru_cache(maxsize=8)
def draw_counts(key: str, n: int, reps: int, seed: int) -> np.ndarray:
    """The multiplicities of ``draws`` for one entity: blocks x replicates.  ``key``: its keys as text, joined by '|'."""
    start = f"{seed}|{key}|".encode()
    out = np.zeros((n, reps))
    for rep in range(reps):
        own = start + b"%d|" % rep
        drawn = [int(hashlib.md5(own + b"%d" % i).hexdigest()[:13], 16) % n for i in range(n)]
        out[:, rep] = np.bincount(drawn, minlength=n)
    return out


def weights(key: str, n: int, reps: int | None, seed: int) -> np.ndarray:
    """Blocks x replicates; without ``reps`` the n replicates that leave out one block each."""
    return 1.0 - np.eye(n) if reps is None else draw_counts(key, n, reps, seed)


def _named(df: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the number of each row's block, that of all blocks of its keys, and the keys as text."""
    n = blocks.groupBy(*keys).agg(F.count("*").alias("_n"))
    text = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    return df.join(blocks, [*keys, "anchor_pos"]).join(n, list(keys)).withColumn("_key", text)


def _typed(df: DataFrame, group: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{g}` {kinds[g]}" for g in group)


def resampled(sums: DataFrame, blocks: DataFrame, reps: int | None, keys: Sequence[str], group: Sequence[str], cols: Sequence[str], seed: int = 42) -> DataFrame:
    """(group, rep, cols): for each replicate the sums over drawn blocks, or without ``reps`` over all blocks but ``rep``.

    ``sums``: rows (group, anchor_pos, cols), one for each block; ``group`` holds ``keys``.  A group meets in one task
    as one row for each block.  Sums are doubles.
    """
    rows = _named(sums, blocks, keys).select(*group, "block_no", "_n", "_key", *(F.col(c).cast("double").alias(c) for c in cols))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        w = weights(t["_key"][0].as_py(), t["_n"][0].as_py(), reps, seed)
        got = w[t["block_no"].to_numpy()].T @ np.stack([t[c].to_numpy() for c in cols], axis=1)
        ids = [pa.repeat(k, len(got)) for k in key]
        return pa.Table.from_arrays([*ids, pa.array(range(len(got)), pa.int64()), *(pa.array(got[:, i]) for i in range(len(cols)))], names=[*group, "rep", *cols])

    return rows.groupBy(*group).applyInArrow(run, f"{_typed(rows, group)}, rep long, " + ", ".join(f"`{c}` double" for c in cols))


def score_sums(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, score, tp, fp) of rows with p and empty: one row for each distinct score."""
    return rows.groupBy(*group, F.col("p").alias("score")).agg(F.sum("empty").alias("tp"), F.sum(1 - F.col("empty")).alias("fp"))


def _carried(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, part, tp, fp, _n, _key): for each part of a group that has rows, what each block has in higher parts.

    A group meets as one sum for each part and block, whatever the number of its rows.
    """
    totals = rows.groupBy(*group, "_part", "block_no", "_n", "_key").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        parts, at = np.unique(t["_part"].to_numpy(), return_inverse=True)
        n, block = t["_n"][0].as_py(), t["block_no"].to_numpy()
        above = []
        for c in ("tp", "fp"):
            sums = np.zeros((len(parts), n), np.int64)
            np.add.at(sums, (at, block), t[c].to_numpy())
            higher = sums[::-1].cumsum(0)[::-1] - sums
            above.append(pa.array(list(higher), pa.list_(pa.int64())))
        same = [pa.repeat(v, len(parts)) for v in (*key, t["_n"][0], t["_key"][0])]
        return pa.Table.from_arrays([*same[: len(group)], pa.array(parts.astype(np.int32)), *above, *same[len(group) :]], names=[*group, "_part", "above_tp", "above_fp", "_n", "_key"])

    return totals.groupBy(*group).applyInArrow(run, f"{_typed(rows, group)}, _part int, above_tp array<long>, above_fp array<long>, _n long, _key string")


class _Part:
    """Running sums of all replicates along the scores of one part, largest first."""

    def __init__(self, w: np.ndarray, above_tp: np.ndarray, above_fp: np.ndarray):
        self.w = w
        self.tp, self.fp = above_tp @ w, above_fp @ w
        self.gained, self.own = np.zeros(w.shape[1]), np.zeros(w.shape[1])

    def add(self, score: np.ndarray, block: np.ndarray, tp: np.ndarray, fp: np.ndarray) -> None:
        """Rows in descending order of score, all rows of a score in one call."""
        starts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
        step = max(1, CELLS // self.w.shape[1])
        for a, b in self._slices(starts, len(score), step):
            picked, first = self.w[block[a:b]], starts[(starts >= a) & (starts < b)] - a
            more_tp, more_fp = (np.add.reduceat(x[a:b, None] * picked, first, axis=0) for x in (tp, fp))
            upto_tp, upto_fp = self.tp + more_tp.cumsum(0), self.fp + more_fp.cumsum(0)
            self.gained += (more_tp * upto_tp / np.maximum(upto_tp + upto_fp, 1e-300)).sum(0)
            self.own += more_tp.sum(0)
            self.tp, self.fp = upto_tp[-1], upto_fp[-1]

    @staticmethod
    def _slices(starts: np.ndarray, n: int, step: int) -> Iterator[tuple[int, int]]:
        """Slices of about ``step`` rows that end where scores do."""
        a = 0
        while a < n:
            later = starts[(starts > a) & (starts <= a + step)]
            b = n if a + step >= n else int(later[-1]) if len(later) else int(next(iter(starts[starts > a]), n))
            yield a, b
            a = b


def precision_by_replicate(sums: DataFrame, blocks: DataFrame, reps: int | None, keys: Sequence[str], group: Sequence[str], seed: int = 42) -> DataFrame:
    """(group, rep, average_precision) of each replicate; without ``reps``, of all blocks but number ``rep``.

    ``sums``: rows (group, anchor_pos, score, tp, fp) with whole tp and fp, scores of 0 to 1 (others join the outer
    parts); ``group`` holds ``keys``.  Rows are shuffled once to their part of a group and sorted there, so neither a
    group nor a part is held by a task; each part gives one vector.
    """
    part = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("score") * RANGES))).cast("int")
    rows = _named(sums, blocks, keys).select(*group, part.alias("_part"), "block_no", F.col("score").cast("double").alias("score"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), "_n", "_key")
    heads = _carried(rows, group).withColumn("_kind", F.lit(0))
    both = rows.drop("_n", "_key").withColumn("_kind", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    ordered = both.repartition(*group, "_part").sortWithinPartitions(*group, "_part", "_kind", F.desc("score"), "block_no")
    picked = ordered.select(*group, "_kind", "block_no", "score", "tp", "fp", "above_tp", "above_fp", "_n", "_key")
    k, names = len(group), [*group, "gained", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, None, None

        def closed() -> Iterator[pa.RecordBatch]:
            if held is not None:
                now.add(*held)
            if now is not None:
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (now.gained, now.own))], names)

        for b in batches:
            kind = b.column(k).to_numpy()
            columns = [b.column(k + i).to_numpy(zero_copy_only=False) for i in (2, 1, 3, 4)]
            begins = np.flatnonzero(kind == 0)
            for a, end in zip([0, *begins], [*begins, b.num_rows]):
                if a < end and kind[a] == 0:
                    yield from closed()
                    w = weights(b.column(k + 8)[a].as_py(), b.column(k + 7)[a].as_py(), reps, seed)
                    now = _Part(w, *(np.array(b.column(k + i)[a].as_py(), np.float64) for i in (5, 6)))
                    ids, held, a = [b.column(i).slice(a, 1) for i in range(k)], None, a + 1
                if a < end:
                    rows = [c[a:end] if held is None else np.concatenate((h, c[a:end])) for c, h in zip(columns, held or [None] * 4)]
                    whole = int(np.flatnonzero(rows[0] == rows[0][-1])[0])  # the last score may go on in the next batch
                    if whole:
                        now.add(rows[0][:whole], rows[1][:whole].astype(np.int64), *(r[:whole] for r in rows[2:]))
                    held = (rows[0][whole:], rows[1][whole:].astype(np.int64), *(r[whole:] for r in rows[2:]))
        yield from closed()

    vectors = picked.mapInArrow(run, f"{_typed(rows, group)}, gained array<double>, own array<double>")

    def added(key: tuple, t: pa.Table) -> pa.Table:
        """Sums of a group's vectors, at most one for each part."""
        gained, own = (np.array(t[c].to_pylist()).sum(0) for c in ("gained", "own"))
        ap = np.divide(gained, own, out=np.zeros_like(gained), where=own > 0)
        return pa.Table.from_arrays([*(pa.repeat(v, len(ap)) for v in key), pa.array(range(len(ap)), pa.int64()), pa.array(ap)], names=[*group, "rep", "average_precision"])

    return vectors.groupBy(*group).applyInArrow(added, f"{_typed(rows, group)}, rep long, average_precision double")


def interval(values: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean and central 95 % interval over replicates."""
    q = lambda p: F.percentile(value, p)  # noqa: E731  of as many values as there are replicates
    return values.groupBy(*group).agg(F.avg(value).alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"), F.count("*").alias("reps"))


def leave_one_out(blocks: DataFrame, keys: Sequence[str], block: str, sums: Sequence[str]) -> DataFrame:
    """Totals without each block: the total less the block's own."""
    w = Window.partitionBy(*keys)
    return blocks.withColumns({c: F.sum(c).over(w) - F.col(c) for c in sums}).withColumnRenamed(block, "omitted")
