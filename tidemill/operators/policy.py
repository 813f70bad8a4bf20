"""Sweeps over thresholds and blends, selection on validation rows, and evaluation of what was selected.

Grids are integers; their values are divisions of integers, so equal points are equal numbers everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators.checks import one_to_one
from tidemill.operators.metrics import average_precision, policy_rows, ratio, threshold_metrics
from tidemill.operators.windows import conflict_severity, opening, window_changes, window_summary

THRESHOLDS = 37
DELTAS = (0.05, 0.10, 0.20)


def threshold_grid(spark: SparkSession) -> DataFrame:
    """(thr_idx, threshold): 0.05 to 0.95 by 0.025."""
    return spark.range(THRESHOLDS).select(F.col("id").cast("int").alias("thr_idx"), ((F.col("id") * 25 + 50) / 1000).alias("threshold"))


def level(opening: str = "opening") -> Column:
    """Index of the highest threshold that an opening reaches; -1 for none."""
    i = F.least(F.lit(THRESHOLDS - 1), F.floor((F.col(opening) * 1000 - 50 + 1e-8) / 25).cast("int"))
    return F.greatest(F.coalesce(i, F.lit(-1)), F.lit(-1))


def _from_top(sums: DataFrame, whole: DataFrame, group: Sequence[str], cols: dict[str, Column]) -> DataFrame:
    """All thresholds for each row of ``whole``, with ``cols`` of ``sums`` (by group and i) added up from the top."""
    at = whole.join(F.broadcast(threshold_grid(sums.sparkSession))).join(sums.withColumnRenamed("i", "thr_idx"), [*group, "thr_idx"], "left")
    up = Window.partitionBy(*group).orderBy(F.desc("thr_idx")).rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumns({c: F.coalesce(F.sum(c).over(up), zero) for c, zero in cols.items()})


def sweep_sums(opened: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sums at all thresholds from one histogram of openings: (group, thr_idx, threshold, n, bad, good, em, total, gross_kwh, safe_kwh).

    A step counts for all thresholds up to its opening, so sums by the largest such index, added from the top, are
    the sums at each threshold.  The cost doesn't depend on how many thresholds there are.
    """
    y = F.col("empty") == 1
    kwh = lambda c: F.coalesce(F.sum(F.when(c, F.col("kwh"))), F.lit(0.0))
    sums = opened.groupBy(*group, level().alias("i")).agg(F.count("*").alias("n"), F.count_if(y).alias("good"), F.coalesce(F.sum("kwh"), F.lit(0.0)).alias("gross_kwh"), kwh(y).alias("safe_kwh"))
    whole = sums.groupBy(*group).agg(F.sum("n").alias("total"), F.sum("good").alias("em"))
    out = _from_top(sums, whole, group, {"n": F.lit(0), "good": F.lit(0), "gross_kwh": F.lit(0.0), "safe_kwh": F.lit(0.0)})
    return out.withColumn("bad", F.col("n") - F.col("good"))


def sweep(opened: DataFrame, group: Sequence[str], total: Sequence[str]) -> DataFrame:
    """Policy rows at all thresholds.  ``total``: columns that name one horizon."""
    days = opened.groupBy(*group).agg(F.count_distinct(*total).alias("daily_schedules"))
    out = sweep_sums(opened, group).join(days, list(group))
    return out.select(
        *group, "thr_idx", "threshold", "daily_schedules", F.col("total").alias("total_intervals"), F.col("n").alias("recommended_intervals"), F.col("good").alias("safe_intervals"),
        F.col("bad").alias("conflict_intervals"), (F.col("n") / F.col("total")).alias("coverage"), ratio(F.col("bad"), F.col("n")).alias("conflict_rate"),
        ratio(F.col("good"), F.col("em")).alias("empty_recall"), "gross_kwh", "safe_kwh",
    )


def window_sweep(opened: DataFrame, group: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(group, thr_idx, recommended_windows, safe_windows) at all thresholds, from one histogram of ``window_changes``."""
    changes = window_changes(opened.withColumn("_level", level()), keys, "_level").groupBy(*group, "i").agg(F.sum("windows").alias("windows"), F.sum("conflicts").alias("conflicts"))
    out = _from_top(changes, opened.select(*group).distinct(), group, {"windows": F.lit(0), "conflicts": F.lit(0)})
    return out.select(*group, "thr_idx", F.col("windows").alias("recommended_windows"), (F.col("windows") - F.col("conflicts")).alias("safe_windows"))


def top_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def select_constrained(sweep_rows: DataFrame, keys: Sequence[str], deltas: Sequence[float] = DELTAS, legacy: bool = False) -> DataFrame:
    """For each key and conflict limit the threshold with the most safe load, then recall, then the lowest.

    Where none meets the limit: the least conflict, then the most safe load (``legacy``: then the highest recall),
    with ``met`` 0.  ValueError: columns that name test results.
    """
    guard_selection(sweep_rows)
    grid = sweep_rows.sparkSession.createDataFrame([(d,) for d in deltas], "delta double")
    rows = sweep_rows.join(F.broadcast(grid)).withColumn("met", (F.round("conflict_rate", 9) <= F.col("delta")).cast("int"))
    kwh, conflict = F.round("safe_kwh", 6), F.round("conflict_rate", 9)
    second = F.round("empty_recall", 9) if legacy else kwh
    order = [
        F.desc("met"), F.when(F.col("met") == 1, -kwh).otherwise(conflict), F.when(F.col("met") == 1, -F.round("empty_recall", 9)).otherwise(-second), F.asc("thr_idx"),
    ]
    return top_one(rows, [*keys, "delta"], order)


def guard_selection(df: DataFrame) -> None:
    """Selection must not see test results."""
    if bad := [c for c in df.columns if "test" in c.lower()]:
        raise ValueError(f"selection input names test results: {bad}")


def pareto_front(df: DataFrame, keys: Sequence[str], cost: str = "conflict_rate", gain: str = "safe_kwh", last: str = "thr_idx") -> DataFrame:
    """Adds ``efficient``: for its cost the largest gain, and a larger one than at any lower cost."""
    c, g = F.round(cost, 9), F.round(gain, 6)
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, c).orderBy(g.desc(), last)))
    lower = Window.partitionBy(*keys).orderBy(c, "_place").rowsBetween(Window.unboundedPreceding, -1)  # of a first row: lower costs only
    below = F.max(g).over(lower)
    return ranked.withColumn("efficient", ((F.col("_place") == 1) & (below.isNull() | (g > below))).cast("int")).drop("_place")


def simplex_grid(spark: SparkSession, parts: int = 20) -> DataFrame:
    """(grid_order, w1, w2, w3, nonzero): all triples of multiples of 1/parts that sum to one."""
    a, b = spark.range(parts + 1).select(F.col("id").alias("i")), spark.range(parts + 1).select(F.col("id").alias("j"))
    k = parts - F.col("i") - F.col("j")
    rows = a.join(b, F.col("i") + F.col("j") <= parts).select("i", "j", k.alias("k"))
    # place in the order (i, j) by formula: no global sort
    order = F.col("i") * (parts + 1) - F.expr("div(i * (i - 1), 2)") + F.col("j")
    w = lambda c: F.col(c) / parts
    return rows.select(order.cast("int").alias("grid_order"), w("i").alias("w1"), w("j").alias("w2"), w("k").alias("w3"), sum((F.col(c) > 0).cast("int") for c in "ijk").alias("nonzero"))


def step_parts(step: float) -> int:
    """Number of parts of a step.  ValueError: a step that doesn't divide one."""
    parts = round(1 / step)
    if parts < 1 or abs(parts * step - 1) > 1e-9:
        raise ValueError("step must divide one")
    return parts


def blend_grid(wide: DataFrame, grid: DataFrame, cols: Sequence[str], group: Sequence[str] = (), label: str = "empty") -> DataFrame:
    """Average precision of all blends of the grid (w1.. for cols): (group, grid_order, average_precision).

    ``wide``: distinct score tuples are counted first, so that each blend sees tuples and not rows.
    """
    tuples = wide.groupBy(*group, *cols).agg(F.sum(label).alias("tp"), F.count("*").alias("n"))
    blended = tuples.join(F.broadcast(grid)).withColumn("p", F.round(sum(F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(cols)), 12))
    rows = blended.select(*group, "grid_order", "p", F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("tp").alias("m")), F.struct(F.lit(0).alias("y"), (F.col("n") - F.col("tp")).alias("m")))).alias("x"))
    return average_precision(rows.select(*group, "grid_order", "p", "x.y", "x.m").where("m > 0"), [*group, "grid_order"], "p", "y", "m")


def blend_long(scores: DataFrame, weights: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, p): the weighted sum of ``n`` models' scores (keys, model, p) with weights (model, weight), of a checked sum.

    The query stops where a row of the blend lacks a model or has one twice.
    """
    rows = scores.join(F.broadcast(weights), "model").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("p")).alias("p"), F.count("*").alias("_n"), F.count_distinct("model").alias("_m"))
    whole = (F.col("_n") == n) & (F.col("_m") == n)
    return rows.withColumn("p", F.when(whole, F.col("p")).otherwise(F.raise_error(F.lit("misaligned scores")).cast("double"))).drop("_n", "_m")


JOINT_ORDER = ("safe_kwh desc", "conflict_rate", "average_precision desc", "safe_windows desc", "nonzero", "grid_order")


def joint_order(first: Sequence[str] = JOINT_ORDER) -> list[Column]:
    """Ordering columns, with doubles rounded so that summation order can't decide."""
    out = []
    for c in first:
        name, down = c.split(" ")[0], c.endswith("desc")
        v = F.round(name, 6) if name in ("safe_kwh",) else F.round(name, 9) if name in ("conflict_rate", "average_precision", "safe_window_rate") else F.col(name)
        out.append(v.desc() if down else v.asc())
    return out


def with_best(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``best_ap``, the largest average precision of each of ``keys`` (of all rows, without a window over them, if there are none)."""
    best = grid.groupBy(*keys).agg(F.max("average_precision").alias("best_ap"))
    return grid.join(best, list(keys)) if keys else grid.join(F.broadcast(best))


def select_joint(grid: DataFrame, keys: Sequence[str] = (), floor: float | None = None, limit: float = 0.10) -> DataFrame:
    """The row with the most safe load among those that keep the conflict limit, recommend something and reach the
    share ``floor`` of the best average precision.  Ties: see JOINT_ORDER.  No row where none is eligible.
    """
    guard_selection(grid)
    ok = with_best(grid, keys).where((F.round("conflict_rate", 9) <= limit) & (F.col("recommended_windows") >= 1) & (F.col("coverage") > 0))
    if floor is not None:
        ok = ok.where(F.round("average_precision", 9) >= F.round(F.col("best_ap") * floor, 9))
    return top_one(ok, keys, joint_order())


def constraint_grid(grid: DataFrame, window_floors: Sequence[float], ap_floors: Sequence[float | None], limit: float = 0.10, keys: Sequence[str] = ()) -> DataFrame:
    """Each row under all pairs of floors, with five flags and their conjunction.  The best precision is that of its ``keys``."""
    guard_selection(grid)
    spark = grid.sparkSession
    pairs = [(i * len(ap_floors) + j, w, a) for i, w in enumerate(window_floors) for j, a in enumerate(ap_floors)]
    base = with_best(grid, keys).withColumn("safe_window_rate", ratio(F.col("safe_windows"), F.col("recommended_windows")))
    rows = base.join(F.broadcast(spark.createDataFrame(pairs, "constraint_order int, window_floor double, ap_floor double")))
    flags = {
        "meets_conflict": F.round("conflict_rate", 9) <= limit,
        "meets_windows": F.round("safe_window_rate", 9) >= F.col("window_floor"),
        "meets_ap": F.col("ap_floor").isNull() | (F.round("average_precision", 9) >= F.round(F.col("best_ap") * F.col("ap_floor"), 9)),
        "has_window": F.col("recommended_windows") >= 1,
        "has_coverage": F.col("coverage") > 0,
    }
    rows = rows.withColumns({n: c.cast("int") for n, c in flags.items()})
    return rows.withColumn("feasible", F.least(*flags))


def select_window_aware(constrained: DataFrame, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """For each of ``keys`` and pair of floors the feasible row with the most safe load.

    A pair without one has no row, or with ``strict`` stops the query.
    """
    guard_selection(constrained)
    order = joint_order(("safe_kwh desc", "safe_window_rate desc", "conflict_rate", "average_precision desc", "safe_windows desc", "nonzero", "grid_order"))
    picks = top_one(constrained.where("feasible = 1"), [*keys, "constraint_order"], order)
    if not strict:
        return picks
    named = F.to_json(F.struct(*keys, "constraint_order"))
    stop = F.raise_error(F.concat(F.lit("no feasible row for "), named))
    found = constrained.groupBy(*keys, "constraint_order").agg(F.max("feasible").alias("_any"))
    return picks.join(found.where(F.when(F.col("_any") == 1, True).otherwise(stop)), [*keys, "constraint_order"]).drop("_any")


def dedupe_strategies(selected: DataFrame, keys: Sequence[str] = (), primary: int = 15) -> DataFrame:
    """(keys, grid_order, representative, rules): pairs of floors with the same pick as one, named by ``primary`` if it is among them."""
    order = F.col("constraint_order")
    rules = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x.cast("string")), "|")
    return selected.groupBy(*keys, "grid_order").agg(F.coalesce(F.max(F.when(order == primary, order)), F.min(order)).alias("representative"), rules.alias("rules"))


#: Fixed rules of a candidate set: (role, what it chooses from, share of the best average precision).
ROLES = (
    ("forecast_optimal", "best_blend", None), ("decision_optimal", "joint", None), ("decision_optimal_0.99", "joint", 0.99),
    ("first_alone", "w1", None), ("second_alone", "w2", None),
    ("floor_none", "joint", None), ("floor_0.95", "joint", 0.95), ("floor_0.98", "joint", 0.98), ("floor_0.99", "joint", 0.99),
)


def candidate_set(grid: DataFrame, keys: Sequence[str], limit: float = 0.10) -> DataFrame:
    """The pick of each role: (keys, role, and the columns of its row).

    Roles of the joint search choose as ``select_joint`` does and may have no pick.  The others take a given blend (that
    with the best average precision, or one component alone) and its threshold: within the limit the most safe load,
    then recall; where none is, the least conflict, then the most safe load.
    """
    guard_selection(grid)
    spark = grid.sparkSession
    blends = grid.groupBy(*keys, "blend_order").agg(F.first("average_precision").alias("average_precision"))
    top = top_one(blends, keys, [F.desc(F.round("average_precision", 9)), F.asc("blend_order")]).select(*keys, F.col("blend_order").alias("_top"))
    rows = with_best(grid, keys).join(top, list(keys)).join(F.broadcast(spark.createDataFrame(list(ROLES), "role string, source string, floor double")))
    kwh, conflict, ap, recall = F.round("safe_kwh", 6), F.round("conflict_rate", 9), F.round("average_precision", 9), F.round("empty_recall", 9)
    met, joint = conflict <= limit, F.col("source") == "joint"
    reaches = F.col("floor").isNull() | (ap >= F.round(F.col("best_ap") * F.col("floor"), 9))
    ok = (
        (joint & met & (F.col("recommended_windows") >= 1) & (F.col("coverage") > 0) & reaches) | ((F.col("source") == "best_blend") & (F.col("blend_order") == F.col("_top")))
        | ((F.col("source") == "w1") & (F.col("w1") == 1)) | ((F.col("source") == "w2") & (F.col("w2") == 1))
    )
    order = [
        F.when(met, 0).otherwise(1), F.when(met, -kwh).otherwise(conflict), F.when(joint, conflict).when(met, -recall).otherwise(-kwh),
        F.when(joint, -ap), F.when(joint, -F.col("safe_windows")), F.when(joint, F.col("nonzero")), F.col("grid_order"),
    ]
    return top_one(rows.where(ok), [*keys, "role"], order).drop("_top", "source", "floor")


def freeze(selected: DataFrame, name: Column, keys: Sequence[str]) -> DataFrame:
    """Strategies for held-out rows: (keys, strategy, w1, w2, w3, threshold, selection_split)."""
    return selected.select(*keys, name.alias("strategy"), "w1", "w2", "w3", "threshold", F.lit("val").alias("selection_split"))


def _applied(rows: DataFrame, frozen: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows under each strategy of their keys, with its score."""
    p = F.round(sum(F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(cols)), 12)
    return rows.join(frozen, list(keys)).withColumn("p", p)


def evaluate_fixed(frozen: DataFrame, everything: DataFrame, daily: DataFrame, cols: Sequence[str], keys: Sequence[str], length: int = 4) -> DataFrame:
    """Held-out metrics of frozen strategies: average precision over ``everything``, policy and windows over ``daily``.

    Both: rows with the scores ``cols``; ``daily`` holds one horizon a day.  The query stops at a strategy that wasn't
    selected on validation, and at one that is named twice.
    """
    guard = F.when(F.col("selection_split") == "val", F.col("selection_split")).otherwise(F.raise_error(F.lit("strategies must be selected on validation")))
    frozen = frozen.withColumn("selection_split", guard).where("selection_split is not null")
    by = [*keys, "strategy"]
    few = frozen.select(*by, "w1", "w2", "w3", "threshold")
    # distinct score tuples first: each strategy sees tuples, not rows
    tuples = everything.groupBy(*keys, *cols).agg(F.sum("empty").alias("_tp"), F.count("*").alias("_n"))
    pair = F.array(F.struct(F.lit(1).alias("y"), F.col("_tp").alias("m")), F.struct(F.lit(0).alias("y"), (F.col("_n") - F.col("_tp")).alias("m")))
    scored = _applied(tuples, few, cols, keys).select(*by, "p", F.explode(pair).alias("x")).select(*by, "p", "x.y", "x.m").where("m > 0")
    m = daily_mask(few, daily, cols, keys, length)
    windows = window_summary(m, by, [*by, "anchor_pos"]).select(*by, "recommended_windows", "safe_windows", "conflict_windows")
    rows = policy_rows(m, by, ["anchor_pos"]).join(windows, by, "left").fillna(0, ["recommended_windows", "safe_windows", "conflict_windows"])
    return one_to_one(one_to_one(frozen, average_precision(scored, by, "p", "y", "m"), by), rows, by)


def daily_mask(frozen: DataFrame, daily: DataFrame, cols: Sequence[str], keys: Sequence[str], length: int = 4) -> DataFrame:
    """Daily rows under each frozen strategy, with ``rec``: whether the step is recommended."""
    at = opening(_applied(daily, frozen, cols, keys), [*keys, "strategy", "anchor_pos"], length)
    return at.withColumn("rec", F.coalesce(F.col("opening") >= F.col("threshold") - 1e-11, F.lit(False)))


def strategy_diagnostic(frozen: DataFrame, everything: DataFrame, daily: DataFrame, cols: Sequence[str], keys: Sequence[str], length: int = 4) -> DataFrame:
    """``evaluate_fixed`` with precision, recall and F1 at one half, the share of safe windows and how bad the conflicts are."""
    by = [*keys, "strategy"]
    few = frozen.select(*by, "w1", "w2", "w3", "threshold")
    point = threshold_metrics(_applied(everything.select(*keys, *cols, "empty"), few, cols, keys), by).select(*by, "precision", "recall", "f1")
    worst = conflict_severity(daily_mask(few, daily, cols, keys, length), [*by, "anchor_pos"])
    worst = worst.groupBy(*by).agg(F.max("longest_minutes").alias("longest_minutes"), F.sum("occupied_minutes").alias("occupied_minutes"))
    out = evaluate_fixed(frozen, everything, daily, cols, keys, length).join(point, by).join(worst, by, "left").fillna(0, ["longest_minutes", "occupied_minutes"])
    return out.withColumn("safe_window_rate", ratio(F.col("safe_windows"), F.col("recommended_windows")))
