"""Forecast and policy metrics by group.  Scores are grouped first, so running sums see distinct scores only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalar import clip_score


def ratio(a, b):
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


#: Parts of the range of scores within which running sums are taken; their totals are added up afterwards.
PARTS = 4096


def running_sums(df: DataFrame, group: Sequence[str], score: str, sums: dict[str, str], down: bool = True) -> DataFrame:
    """Adds running sums (new name -> column) along ``score``, for rows with different scores in each group.

    No task sorts a whole group: rows meet by group and part of the score's range (of 0 to 1; what lies beyond joins the
    outer parts), and one small row for each part, at most PARTS of a group, carries the totals.
    """
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(F.col(score) * PARTS))).cast("int")
    cut = df.withColumn("_part", part)
    by = F.desc if down else F.asc
    before = Window.partitionBy(*group).orderBy(by("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_part").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    carried = totals.select(*group, "_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*group, "_part").orderBy(by(score)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, [*group, "_part"])
    return joined.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_part", *(f"_{n}" for n in sums))


def score_curve(df: DataFrame, group: Sequence[str], score: str = "p", label: str = "empty", weight: str | None = None) -> DataFrame:
    """Running true and false positives over distinct scores, largest first: (group, score, tp, fp, cum_tp, cum_fp)."""
    w = F.col(weight) if weight else F.lit(1)
    by = df.groupBy(*group, F.col(score).alias("score")).agg(F.sum(w * F.col(label)).cast("double").alias("tp"), F.sum(w * (1 - F.col(label))).cast("double").alias("fp"))
    return running_sums(by, group, "score", {"cum_tp": "tp", "cum_fp": "fp"})


def curve_precision(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sum of recall steps times precision along a curve; 0 without positives."""
    gained = F.sum(F.col("tp") * F.col("cum_tp") / F.greatest(F.col("cum_tp") + F.col("cum_fp"), F.lit(1e-300)))
    return curve.groupBy(*group).agg(ratio(gained, F.sum("tp")).alias("average_precision"))


def average_precision(df: DataFrame, group: Sequence[str], score: str = "p", label: str = "empty", weight: str | None = None) -> DataFrame:
    """Sum of recall steps times precision over distinct scores; 0 without positives."""
    return curve_precision(score_curve(df, group, score, label, weight), group)


def auroc(df: DataFrame, group: Sequence[str], score: str = "p", label: str = "empty") -> DataFrame:
    """Rank AUC with half credit for ties; null with one class only."""
    c = score_curve(df, group, score, label)
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2))
    return c.groupBy(*group).agg(F.when((F.sum("tp") > 0) & (F.sum("fp") > 0), area / (F.sum("tp") * F.sum("fp"))).alias("auroc"))


def threshold_metrics(df: DataFrame, group: Sequence[str], score: str = "p", label: str = "empty", at: float = 0.5) -> DataFrame:
    """Precision, recall, F1 at a threshold, Brier score and log loss of clipped scores (null with one class)."""
    p, y = clip_score(score), F.col(label)
    yes = p >= at
    tp, pp, ap = F.count_if(yes & (y == 1)), F.count_if(yes), F.count_if(y == 1)
    loss = F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))
    return df.groupBy(*group).agg(
        F.count("*").alias("n"), ratio(tp, pp).alias("precision"), ratio(tp, ap).alias("recall"), ratio(2 * tp, pp + ap).alias("f1"),
        F.avg((p - y) * (p - y)).alias("brier"), F.when((ap > 0) & (ap < F.count("*")), loss).alias("log_loss"),
    )


def model_metrics(df: DataFrame, group: Sequence[str], score: str = "p", label: str = "empty") -> DataFrame:
    clipped = df.withColumn("_p", clip_score(score))
    out = threshold_metrics(df, group, score, label)
    return out.join(average_precision(clipped, group, "_p", label), list(group)).join(auroc(clipped, group, "_p", label), list(group))


def rank_bins(df: DataFrame, group: Sequence[str], order: Sequence[str], n_bins: int = 10, score: str = "p", label: str = "empty", chunk: int = 4096) -> DataFrame:
    """Equal-count bins by rank with full tie keys: (group, bin, mean_p, observed, n, gap); remainders go to both ends.

    A row's rank is the number of rows with a lower score, plus that of rows with its score in lower chunks of the
    first tie key (an integer), plus its place within the chunk.  So neither a group nor a frequent score is sorted by
    one task.
    """
    cut = df.withColumn("_c", F.floor(F.col(order[0]) / chunk))
    chunks = cut.groupBy(*group, F.col(score).alias("_s"), "_c").agg(F.count("*").alias("_k"))
    scores = running_sums(chunks.groupBy(*group, "_s").agg(F.sum("_k").alias("_own")), group, "_s", {"_upto": "_own"}, down=False)
    total = scores.groupBy(*group).agg(F.sum("_own").alias("_n"))
    earlier = Window.partitionBy(*group, "_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.withColumn("_e", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).join(scores, [*group, "_s"]).join(total, list(group))
    before = before.select(*group, F.col("_s").alias(score), "_c", (F.col("_upto") - F.col("_own") + F.col("_e")).alias("_before"), "_n")
    ranked = cut.join(before, [*group, score, "_c"])
    ranked = ranked.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*group, score, "_c").orderBy(*order)))
    place = F.greatest(F.ceil((F.col("_r") - 1) * n_bins / F.greatest(F.col("_n") - 1, F.lit(1))) - 1, F.lit(0))
    out = ranked.groupBy(*group, place.cast("int").alias("bin")).agg(F.avg(score).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("observed"), F.count("*").alias("n"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))


def expected_calibration_error(bins: DataFrame, group: Sequence[str]) -> DataFrame:
    return bins.groupBy(*group).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def quantiles(df: DataFrame, group: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(group, cuts): interpolated quantiles from running counts over distinct values of 0 to 1."""
    by = running_sums(df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_k")), group, "_v", {"_upto": "_k"}, down=False)
    total = by.groupBy(*group).agg(F.sum("_k").alias("_n"))
    rows = by.join(total, list(group))
    place = lambda q: (F.col("_n") - 1) * q  # noqa: E731  a place between two rows, counted from 0
    nth = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    ends = rows.groupBy(*group, "_n").agg(*(nth(F.floor(place(q))).alias(f"_a{i}") for i, q in enumerate(at)), *(nth(F.ceil(place(q))).alias(f"_b{i}") for i, q in enumerate(at)))
    cut = lambda i, q: F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (place(q) - F.floor(place(q))))
    return ends.select(*group, F.array(*(cut(i, q) for i, q in enumerate(at))).alias("cuts"))


def quantile_bins(df: DataFrame, group: Sequence[str], n_bins: int = 10, score: str = "p", label: str = "empty") -> DataFrame:
    """Bins by value quantiles: equal scores stay together, empty bins don't appear."""
    cuts = quantiles(df, group, score, [k / n_bins for k in range(1, n_bins)])
    by = df.groupBy(*group, F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_y"))  # distinct scores
    placed = by.join(cuts, list(group)).withColumn("bin", F.aggregate("cuts", F.lit(0), lambda a, c: a + (c < F.col("_s")).cast("int")))
    n = F.sum("_n")
    return placed.groupBy(*group, "bin").agg((F.sum(F.col("_s") * F.col("_n")) / n).alias("mean_p"), (F.sum("_y") / n).alias("observed"), n.alias("n"))


def policy_rows(df: DataFrame, group: Sequence[str], days: Sequence[str]) -> DataFrame:
    """Interval and load accounting of recommended steps.  ``days``: columns that name one horizon."""
    rec, y = F.col("rec"), F.col("empty") == 1
    n_rec, safe = F.count_if(rec), F.count_if(rec & y)
    kwh = lambda c: F.coalesce(F.sum(F.when(c, F.col("kwh"))), F.lit(0.0))
    days_n = F.count_distinct(*days)
    return df.groupBy(*group).agg(
        days_n.alias("daily_schedules"), F.count("*").alias("total_intervals"), n_rec.alias("recommended_intervals"), safe.alias("safe_intervals"),
        F.count_if(rec & ~y).alias("conflict_intervals"), (n_rec / F.count("*")).alias("coverage"), ratio(F.count_if(rec & ~y), n_rec).alias("conflict_rate"),
        ratio(safe, F.count_if(y)).alias("empty_recall"), kwh(rec).alias("gross_kwh"), kwh(rec & y).alias("safe_kwh"), kwh(rec & ~y).alias("conflict_kwh"),
        (kwh(rec & y) / F.greatest(days_n, F.lit(1))).alias("kwh_per_day"),
    )


def zero_event_bound(n):
    """Upper 95 % bound of a rate after n trials without an event."""
    return 1 - F.pow(F.lit(0.05), 1 / n)
