"""Direct linear forecasts: for each entity one logistic map from its last labels to each of the next steps.

All steps of an entity share their inputs, so a row is an anchor with two arrays, its history and its targets; nothing
is multiplied by the horizon.  Fits are reweighted least squares: in each round a task turns a chunk of anchors into one
Gram matrix and one gradient for every step, these are added up by entity and step, and each step's system is solved
where its sums meet.  Coefficients are a table like any other, so the driver holds none, however many entities there are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.bins import history_window
from tidemill.sources.scratch import materialise

#: Positions of a chunk of anchors (a year of quarter hours), rounds at most, and the step that ends them.
CHUNK, ROUNDS, CLOSE = 96 * 365, 25, 1e-9
#: Weight of the squared coefficients, and the longest step of a coefficient in a round.
RIDGE, STRIDE = 1.0, 4.0


def windows(bins: DataFrame, anchors: DataFrame, keys: Sequence[str], length: int = 96) -> DataFrame:
    """(keys, split, pos, x, y): of each anchor the last ``length`` scaled counts of occupied, and the next labels of empty.

    ``anchors``: (keys, pos, split, bin_start, b1); means and deviations are those of the bins before b1, a deviation
    under 1e-6 counts as 1.
    """
    bounds = anchors.select(*keys, "b1").distinct()
    scale = bins.join(bounds, list(keys)).where("bin_start < b1").groupBy(*keys).agg(F.avg("occupied").alias("_m"), F.stddev_pop("occupied").alias("_s"))
    past = history_window(bins.select(*keys, "pos", "occupied"), "occupied", keys, length).select(*keys, "pos", F.col("history").alias("x"))
    ahead = history_window(bins.select(*keys, "pos", "empty"), "empty", keys, length).select(*keys, (F.col("pos") - length).alias("pos"), F.col("history").alias("y"))
    both = anchors.select(*keys, "pos", "split").join(past, [*keys, "pos"]).join(ahead, [*keys, "pos"]).join(scale, list(keys))
    deviation = F.when(F.col("_s") < 1e-6, 1.0).otherwise(F.col("_s"))
    whole = (F.size("x") == length) & (F.size("y") == length)
    return both.where(whole).select(*keys, "split", "pos", F.transform("x", lambda v: (v - F.col("_m")) / deviation).alias("x"), F.transform("y", lambda v: v.cast("double")).alias("y"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new references, so that a table can meet what it was made from."""
    return df.toDF(*df.columns)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def round_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, positive: float) -> tuple[np.ndarray, np.ndarray]:
    """(Gram matrices, gradients) of all steps for inputs with a last column of ones; rows with label 1 weigh ``positive``."""
    p = logistic(x @ w.T)
    weight = np.where(y > 0, positive, 1.0)
    gradient = (weight * (y - p)).T @ x
    curve = weight * p * (1 - p)
    return np.stack([(x * curve[:, j : j + 1]).T @ x for j in range(y.shape[1])]), gradient


def next_weights(gram: np.ndarray, gradient: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """One step's coefficients after a round; the last one, the intercept, bears no penalty."""
    penalty = np.full(len(w), ridge)
    penalty[-1] = 0.0
    step = np.linalg.solve(gram + np.diag(penalty + 1e-9), gradient - penalty * w)
    return w + step * min(1.0, STRIDE / max(np.abs(step).max(), 1e-300))


def fit_maps(rows: DataFrame, keys: Sequence[str], length: int = 96, ridge: float = RIDGE, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """(keys, step, coefficients): ``length`` weights and the intercept for each step of each entity, steps from 1.

    ``rows``: of ``windows``, better a written table; it is fitted on split train.  Both classes are balanced by a
    weight of label 1, negatives over positives, held between 0.25 and 8.
    """
    k, kinds = len(keys), dict(rows.dtypes)
    of_keys = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    train = rows.where("split = 'train'").withColumn("_chunk", F.floor(F.col("pos") / chunk))
    ones = F.sum(F.aggregate("y", F.lit(0.0), lambda a, v: a + v))
    weight = train.groupBy(*keys).agg(F.greatest(F.lit(0.25), F.least(F.lit(8.0), (F.count("*") * length - ones) / F.greatest(ones, F.lit(1.0)))).alias("_positive"))
    chunks = materialise(train.select(*keys, "_chunk").distinct().join(weight, list(keys)), "map-chunks")
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), length + 1), length)
    now = weight.select(*keys, zeros.alias("all"))
    names = [*keys, "step", "gram", "gradient", "old"]

    def sums(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t.type) for t in (right if right.num_rows else left).select(list(keys)).columns] + [pa.array([], pa.int32())] + [pa.array([], pa.list_(pa.float64()))] * 3, names=names)
        x, y = _with_one(_matrix(left["x"], left.num_rows)), _matrix(left["y"], left.num_rows)
        w = np.array(right["all"][0].as_py())
        gram, gradient = round_sums(x, y, w, right["_positive"][0].as_py())
        lists = [pa.array(list(v.reshape(length, -1)), pa.list_(pa.float64())) for v in (gram, gradient, w)]
        return pa.Table.from_arrays([*(pa.repeat(v, length) for v in key[:k]), pa.array(np.arange(1, length + 1, dtype=np.int32)), *lists], names=names)

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        gram, gradient = (_matrix(t[c], t.num_rows).sum(0) for c in ("gram", "gradient"))
        old = np.array(t["old"][0].as_py())
        new = next_weights(gram.reshape(len(old), -1), gradient, old, ridge)
        moved = float(np.abs(new - old).max())
        return pa.Table.from_arrays([*(pa.repeat(v, 1) for v in key), pa.array([new.tolist()], pa.list_(pa.float64())), pa.array([moved])], names=[*keys, "step", "coefficients", "moved"])

    for _ in range(rounds):
        known = _fresh(chunks.join(now, list(keys)))
        partial = train.groupBy(*keys, "_chunk").cogroup(known.groupBy(*keys, "_chunk")).applyInArrow(sums, f"{of_keys}, step int, gram array<double>, gradient array<double>, old array<double>")
        solved = materialise(partial.groupBy(*keys, "step").applyInArrow(solve, f"{of_keys}, step int, coefficients array<double>, moved double"), "maps")
        now = solved.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "coefficients"))), lambda s: s["coefficients"]).alias("all"))
        if (solved.agg(F.max("moved").alias("m")).first().m or 0.0) < CLOSE:
            break
    return solved.select(*keys, "step", "coefficients")


def score_maps(rows: DataFrame, maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, split, anchor_pos, step, empty, p) of all rows of ``windows``."""
    every = maps.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "coefficients"))), lambda s: s["coefficients"]).alias("all"))
    keyed = rows.withColumn("_chunk", F.floor(F.col("pos") / CHUNK))
    known = _fresh(keyed.select(*keys, "_chunk").distinct().join(every, list(keys)))
    kinds = dict(rows.dtypes)
    of_keys = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    names = [*keys, "split", "pos", "y", "p"]

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if right.num_rows else 0
        left = left.slice(0, n)
        p = logistic(_with_one(_matrix(left["x"], n)) @ np.array(right["all"][0].as_py()).T) if n else np.empty((0, 1))
        return pa.Table.from_arrays([*(left[c] for c in names[:-1]), pa.array(list(p), pa.list_(pa.float64()))], names=names)

    scored = keyed.groupBy(*keys, "_chunk").cogroup(known.groupBy(*keys, "_chunk")).applyInArrow(score, f"{of_keys}, split string, pos {kinds['pos']}, y array<double>, p array<double>")
    each = scored.select(*keys, "split", F.col("pos").alias("anchor_pos"), F.posexplode(F.arrays_zip("y", "p")).alias("step", "one"))
    return each.select(*keys, "split", "anchor_pos", (F.col("step") + 1).alias("step"), F.col("one.y").cast("int").alias("empty"), F.col("one.p").alias("p"))
