"""Spark ML forecasts: fitted on the training split, scored on the others.  Fits start jobs at once, as Spark ML does."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.bins import future_explode
from tidemill.operators.features import rolling_origin_folds
from tidemill.operators.metrics import average_precision

#: Boosting rounds at most, and those of fits that have no validation rows to stop them.
MOST_ROUNDS, ROUNDS = 320, 20


def gbt(seed: int = 42, rounds: int = ROUNDS, **more):
    """Boosted trees that see 85 % of the features at each node, so that seeds differ."""
    return GBTClassifier(featuresCol="x", labelCol="empty", weightCol="w", maxDepth=5, maxIter=rounds, stepSize=0.1, featureSubsetStrategy="0.85", seed=seed, **more)


def stopped_gbt(seed: int = 42, rounds: int = MOST_ROUNDS):
    """The same, ended when the loss on rows with ``_held`` rises."""
    return gbt(seed, rounds, validationIndicatorCol="_held", validationTol=0.0)


def forest(seed: int = 42, trees: int = 70):
    return RandomForestClassifier(featuresCol="x", labelCol="empty", weightCol="w", numTrees=trees, maxDepth=14, minInstancesPerNode=20, featureSubsetStrategy="sqrt", seed=seed)


def linear():
    return LogisticRegression(featuresCol="x", labelCol="empty", weightCol="w", maxIter=30, regParam=1e-3)


def _vectors(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="x").transform(rows)


def _fit(rows: DataFrame, make: Callable):
    """Rows weighted so that both classes weigh the same."""
    n = rows.agg(F.avg("empty").alias("p")).first().p
    p = min(max(n or 0.5, 1e-6), 1 - 1e-6)
    return make().fit(rows.withColumn("w", F.when(F.col("empty") == 1, 0.5 / p).otherwise(0.5 / (1 - p))))


def _scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def fit_and_score(rows: DataFrame, cols: Sequence[str], make: Callable) -> DataFrame:
    """Validation and test rows with the probability of empty as p.  ``rows``: better a written table; a fit reads it in each round."""
    vectors = _vectors(rows, cols)
    return _scored(_fit(vectors.where("split = 'train'"), make), vectors.where("split <> 'train'"))


def fit_and_score_seeds(rows: DataFrame, cols: Sequence[str], make: Callable, seeds: Sequence[int]) -> DataFrame:
    """The same for each seed, with a column ``seed``; ``make(seed)``."""
    out = None
    for seed in seeds:  # one fit each
        one = fit_and_score(rows, cols, lambda s=seed: make(s)).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def fit_seeds(samples: Sequence[DataFrame], cols: Sequence[str], make: Callable, seeds: Sequence[int]) -> list:
    """A model for each seed, ``make(seed)``, fitted at the same time, each on its own written rows of splits train and val.

    Rows of val only end a fit, where the estimator asks for such rows; no fit learns from them.  Both classes weigh the same.
    """

    def one(rows: DataFrame, seed: int):
        estimator = make(seed)
        stops = estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol")
        used = rows.withColumn("_held", F.col("split") == "val") if stops else rows.where("split = 'train'")
        return _fit(_vectors(used, cols), lambda: estimator)

    with ThreadPoolExecutor(len(seeds)) as pool:
        return list(pool.map(one, samples, seeds))


def mean_of_models(models: Sequence, rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``rows`` with p, the mean over the models of the probability of empty; one pass."""
    out, names = _vectors(rows, cols), []
    for i, model in enumerate(models):
        names.append(f"_p{i}")
        out = model.transform(out).withColumn(names[-1], vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return out.withColumn("p", sum(F.col(n) for n in names) / len(names)).drop("x", *names)


def permutation_importance(rows: DataFrame, cols: Sequence[str], make: Callable, which: Sequence[str], parts: int = 64) -> DataFrame:
    """(feature, drop) of average precision on validation when a feature's values are dealt out anew.

    Rows are dealt within ``parts`` parts by hash, so none is sorted as a whole.  One join pairs each row with another;
    each feature then is one copy of the row with that feature taken from its partner.
    """
    model = _fit(_vectors(rows, cols).where("split = 'train'"), make)
    part = F.pmod(F.xxhash64(*cols), F.lit(parts))
    val = rows.where("split = 'val'").select("empty", F.array(*(F.col(c).cast("double") for c in cols)).alias("v"), part.alias("_part"))
    in_part = lambda *o: F.row_number().over(Window.partitionBy("_part").orderBy(*o))
    a = val.withColumn("_i", in_part(F.xxhash64("v"), "v"))
    b = a.select("_part", F.col("v").alias("u"), in_part(F.xxhash64(F.col("_i"), F.lit(7))).alias("_i"))
    which_at = F.array(F.lit(-1), *(F.lit(list(cols).index(c)) for c in which))  # -1: as it is
    paired = a.join(b, ["_part", "_i"]).withColumn("k", F.explode(which_at))
    moved = paired.select("k", "empty", array_to_vector(F.transform("v", lambda x, j: F.when(j == F.col("k"), F.element_at("u", j + 1)).otherwise(x))).alias("x"))
    ap = average_precision(_scored(model, moved), ["k"])
    whole = ap.where("k = -1").select(F.col("average_precision").alias("base"))
    named = F.element_at(F.array(*(F.lit(c) for c in cols)), F.col("k") + 1)
    return ap.where("k >= 0").join(F.broadcast(whole)).select(named.alias("feature"), (F.col("base") - F.col("average_precision")).alias("drop"))


def slot_average_of_folds(bins: DataFrame, keys: Sequence[str], horizon: int = 96) -> DataFrame:
    """(keys, fold, anchor_pos, step, empty, p) of each fold's validation anchors: the mean of the slot before the fold's
    boundary, or of all bins before it where the slot has none."""
    folds = rolling_origin_folds(bins, keys)
    before = bins.select(*keys, "bin_start", "slot", "empty").join(folds.select(*keys, "fold", "b").distinct(), list(keys)).where("bin_start < b")
    slots = before.groupBy(*keys, "fold", "slot").agg(F.avg("empty").alias("slot_mean"))
    mean = before.groupBy(*keys, "fold").agg(F.avg("empty").alias("mean"))
    steps = future_explode(folds.where("role = 'val'").select(*keys, "fold", "pos"), horizon).withColumnRenamed("pos", "anchor_pos")
    target = bins.select(*keys, F.col("pos").alias("target_pos"), "slot", "empty")
    rows = steps.join(target, [*keys, "target_pos"]).join(slots, [*keys, "fold", "slot"], "left").join(mean, [*keys, "fold"])
    return rows.select(*keys, "fold", "anchor_pos", "step", "empty", F.coalesce("slot_mean", "mean").alias("p"))
