"""Splits, lags and rolling features, fitted on the rows that they may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalar import is_midnight, week_floor
from tidemill.operators.chunks import CHUNK, with_halo


def split_bounds(bins: DataFrame, keys: Sequence[str], train: float = 0.5, val: float = 0.25) -> DataFrame:
    """(keys, n, b1, b2): Mondays before the rows at which training and validation end."""
    n = bins.groupBy(*keys).agg(F.count("*").alias("n"))
    at = bins.join(n, list(keys)).where((F.col("pos") == F.floor(F.col("n") * train)) | (F.col("pos") == F.floor(F.col("n") * (train + val))))
    first = at.groupBy(*keys, "n").agg(F.min("bin_start").alias("b1"), F.max("bin_start").alias("b2"))
    return first.select(*keys, "n", week_floor("b1").alias("b1"), week_floor("b2").alias("b2"))


def chrono_split(bins: DataFrame, keys: Sequence[str], history: int = 96, horizon: int = 96, gap: int = 96, train: float = 0.5, val: float = 0.25) -> DataFrame:
    """Anchors with their split: train targets end before b1, validation lies a gap behind b1 and before b2, test a gap behind b2."""
    anchors = bins.join(split_bounds(bins, keys, train, val), list(keys))
    anchors = anchors.where((F.col("pos") >= history - 1) & (F.col("pos") < F.col("n") - horizon))
    quarter = lambda k: F.expr(f"interval {15 * k} minutes")
    begin, end = F.col("bin_start") - quarter(history - 1), F.col("bin_start") + quarter(horizon)
    split = (
        F.when(end < F.col("b1"), "train").when((begin >= F.col("b1") + quarter(gap)) & (end < F.col("b2")), "val")
        .when(begin >= F.col("b2") + quarter(gap), "test")
    )
    return anchors.withColumn("split", split).where("split is not null").drop("n")


def daily_anchors(anchors: DataFrame, keys: Sequence[str], time: str = "bin_start", horizon: int = 96) -> DataFrame:
    """One anchor a day: those at midnight, or every ``horizon``-th from the first where a key has none at midnight."""
    ends = anchors.groupBy(*keys).agg(F.bool_or(is_midnight(time)).alias("_any"), F.min("pos").alias("_first"))
    chosen = F.when(F.col("_any"), is_midnight(time)).otherwise((F.col("pos") - F.col("_first")) % horizon == 0)
    return anchors.join(ends, list(keys)).where(chosen).drop("_any", "_first")


def rolling_origin_folds(bins: DataFrame, keys: Sequence[str], cuts: Sequence[float] = (0.5, 0.6, 0.7), days: int = 21, least: int = 100, history: int = 96, horizon: int = 96) -> DataFrame:
    """Anchors with fold and role (train or val); folds with under ``least`` anchors of either role are left out."""
    spark = bins.sparkSession
    grid = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cuts)], "fold int, cut double")
    n = bins.groupBy(*keys).agg(F.count("*").alias("n"))
    bound = n.join(F.broadcast(grid)).withColumn("at", F.floor(F.col("n") * F.col("cut")))
    edge = bins.select(*keys, F.col("pos").alias("at"), week_floor("bin_start").alias("b")).join(bound, [*keys, "at"])
    rows = bins.join(edge.select(*keys, "fold", "n", "b"), list(keys)).where((F.col("pos") >= history - 1) & (F.col("pos") < F.col("n") - horizon))
    begin, end = F.col("bin_start") - F.expr(f"interval {15 * (history - 1)} minutes"), F.col("bin_start") + F.expr(f"interval {15 * horizon} minutes")
    role = F.when(end < F.col("b"), "train").when((begin >= F.col("b") + F.expr("interval 24 hours")) & (end < F.col("b") + F.expr(f"interval {days} days")), "val")
    rows = rows.withColumn("role", role).where("role is not null")
    ok = rows.groupBy(*keys, "fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "val").alias("v")).where((F.col("a") >= least) & (F.col("v") >= least))
    return rows.join(ok.select(*keys, "fold"), [*keys, "fold"], "left_semi")


def lags(bins: DataFrame, value: str, ks: Sequence[int], keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """The values ``ks`` bins back, over bins with gapless ``pos``; a long series is spread over chunks."""

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("pos")
        return rows.withColumns({f"{value}_lag_{k}": F.lag(value, k).over(w) for k in ks})

    return with_halo(bins, keys, max(ks), within, chunk)


def rolling_means(bins: DataFrame, value: str, ws: Sequence[int], keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Mean of the ``w`` values before each bin, null where there are fewer; the bin itself is not in it."""

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        over = lambda k: Window.partitionBy(*by).orderBy("pos").rowsBetween(-k, -1)
        return rows.withColumns({f"{value}_mean_{k}": F.when(F.col("pos") >= k, F.avg(value).over(over(k))) for k in ws})

    return with_halo(bins, keys, max(ws), within, chunk)


def fill_by_split(anchors: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Nulls become the column's mean over the anchors of the same split, or 0 if it has none."""
    means = anchors.groupBy(*keys, "split").agg(*(F.avg(c).alias(f"_{c}") for c in cols))
    joined = anchors.join(means, [*keys, "split"])
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_{c}", F.lit(0.0)) for c in cols}).drop(*(f"_{c}" for c in cols))


def train_scaler(df: DataFrame, cols: Sequence[str], role: str = "split", fit: str = "train") -> DataFrame:
    """(feature, mean, std) over the training rows; a standard deviation under 1e-6 counts as 1."""
    train = df.where(F.col(role) == fit)
    both = train.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols))
    long = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"{c}.m").alias("mean"), F.col(f"{c}.s").alias("std")) for c in cols))).alias("x")).select("x.*")
    return long.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def stratified_sample(df: DataFrame, label: str, rows: int, order: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """At most ``rows`` of each key: up to half with label 1, then others, then whatever is left, in the given order within each.

    No job runs before the caller's.  Tasks keep the first ``rows`` of each key and label before anything is shuffled;
    ``order`` must tell rows apart (say by a hash and an id), so that a sample is the same each time.
    """
    of_label = Window.partitionBy(*keys, label).orderBy(*order)
    first = df.where(F.col(label).isin(0, 1)).withColumn("_nth", F.row_number().over(of_label)).where(F.col("_nth") <= rows)
    of_key = Window.partitionBy(*keys)
    n = first.withColumns({"_pos": F.count_if(F.col(label) == 1).over(of_key), "_neg": F.count_if(F.col(label) == 0).over(of_key)})
    neg = F.least(F.col("_neg"), rows - F.least(F.col("_pos"), F.lit(rows // 2)))
    pos = F.least(F.col("_pos"), rows - neg)  # the rest of the room goes to the positive rows
    return n.where(F.col("_nth") <= F.when(F.col(label) == 1, pos).otherwise(neg)).drop("_nth", "_pos", "_neg")


def class_weight(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pos_weight): negatives over positives, held between 0.25 and 8."""
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    return df.groupBy(*keys).agg(F.greatest(F.lit(0.25), F.least(F.lit(8.0), neg / F.greatest(pos, F.lit(1)))).alias("pos_weight"))
