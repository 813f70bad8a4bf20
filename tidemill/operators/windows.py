"""Stable windows: runs of steps with a score at or above a threshold that last long enough, within one horizon.

``opening`` (a sliding minimum, then a sliding maximum) gives for each step the highest threshold at which the step
still lies in such a run.  One pass serves all thresholds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def opening(df: DataFrame, keys: Sequence[str], length: int = 4, score: str = "p", out: str = "opening") -> DataFrame:
    """Adds the opening; null where no run of ``length`` steps covers the step.  ``keys``: of one horizon and model."""
    w = Window.partitionBy(*keys).orderBy("step")
    ahead, back = w.rowsBetween(0, length - 1), w.rowsBetween(-(length - 1), 0)
    low = F.when(F.count(score).over(ahead) == length, F.min(score).over(ahead))
    return df.withColumn("_low", low).withColumn(out, F.max("_low").over(back)).drop("_low")


def openings(df: DataFrame, keys: Sequence[str], lengths: Sequence[int], score: str = "p") -> DataFrame:
    """A row for each step and least length (min_steps) with its opening; all lengths in one sort of the horizons."""
    for k in lengths:
        df = opening(df, keys, k, score, f"_o{k}")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("min_steps"), F.col(f"_o{k}").alias("opening")) for k in lengths)))
    return df.withColumn("_x", each).select(*(c for c in df.columns if not c.startswith("_o")), "_x.min_steps", "_x.opening")


def stable_mask(df: DataFrame, keys: Sequence[str], threshold, length: int = 4, score: str = "p") -> DataFrame:
    """Adds ``rec``: whether the step is recommended at the threshold (a column or a number)."""
    cut = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    return opening(df, keys, length, score).withColumn("rec", F.coalesce(F.col("opening") >= cut, F.lit(False))).drop("opening")


def extract_windows(df: DataFrame, keys: Sequence[str], flag: str = "rec", least: int = 1, extra: dict | None = None) -> DataFrame:
    """Maximal runs of flagged steps: (keys, window_no, start_step, end_step_excl, length) and extra aggregates."""
    w = Window.partitionBy(*keys).orderBy("step")
    on = df.where(flag).withColumn("_island", F.col("step") - F.row_number().over(w))
    runs = on.groupBy(*keys, "_island").agg(F.min("step").alias("start_step"), (F.max("step") + 1).alias("end_step_excl"), F.count("*").alias("length"), *((extra or {}).values()))
    numbered = runs.where(F.col("length") >= least).withColumn("window_no", F.row_number().over(Window.partitionBy(*keys).orderBy("start_step")))
    return numbered.drop("_island")


def window_summary(df: DataFrame, group: Sequence[str], keys: Sequence[str], flag: str = "rec", empty: str = "empty") -> DataFrame:
    """Counts and durations of windows by ``group``; a window with any occupied step is a conflict window."""
    runs = extract_windows(df, keys, flag, extra={"safe": F.min(empty).alias("safe")})
    hours, safe = F.col("length") * 0.25, F.col("safe") == 1
    return runs.groupBy(*group).agg(
        F.count("*").alias("recommended_windows"), F.count_if(safe).alias("safe_windows"), F.count_if(~safe).alias("conflict_windows"),
        (F.count_if(~safe) / F.count("*")).alias("window_conflict_rate"), F.avg(hours).alias("avg_window_hours"), F.sum(hours).alias("total_window_hours"),
        F.coalesce(F.avg(F.when(safe, hours)), F.lit(0.0)).alias("avg_safe_window_hours"),
    )


def window_changes(df: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """(keys, i, windows, conflicts): what to add at level ``i`` so that sums from the top count windows at each level.

    ``level``: column with the highest level at which the step is recommended, -1 if at none.  At a level a window
    begins where a step reaches it and the step before doesn't, so windows are steps less neighbouring pairs.  A
    window with occupied steps is counted at the first of these: an occupied step counts, less that reached together
    with the occupied step before and all steps between.  One pass serves all levels.
    """
    w = Window.partitionBy(*keys).orderBy("step")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    busy = F.when(F.col("empty") == 0, 1).otherwise(0)
    rows = df.select(*keys, "step", F.col(level).alias("_i"), busy.alias("_busy"))
    rows = rows.withColumns({"_both": F.least("_i", F.coalesce(F.lag("_i").over(w), F.lit(-1))), "_part": F.sum("_busy").over(upto)})
    rows = rows.withColumn("_low", F.min("_i").over(Window.partitionBy(*keys, "_part")))  # from an occupied step up to the next
    held = F.least("_i", F.when(F.col("_part") > 1, F.lag("_low").over(w)).otherwise(-1))
    change = lambda i, n, c: F.struct(i.alias("i"), n.alias("windows"), c.alias("conflicts"))
    each = F.array(change(F.col("_i"), F.lit(1), F.col("_busy")), change(F.col("_both"), F.lit(-1), F.lit(0)), change(F.col("_held"), F.lit(0), -F.col("_busy")))
    return rows.withColumn("_held", held).select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("i >= 0")


def detected_windows(df: DataFrame, keys: Sequence[str], lengths: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(true windows, recommended windows) under each least length (min_steps).

    True windows are runs of empty steps, with ``detected``: whether a recommended run of that length overlaps them in
    the same horizon.  Runs are cut once for all lengths.  Within a horizon runs are few, so the equi-join on the
    horizon with a range condition stays small.
    """
    grid = F.broadcast(df.sparkSession.createDataFrame([(k,) for k in lengths], "min_steps int"))
    long_enough = lambda runs: runs.drop("window_no").join(grid, F.col("length") >= F.col("min_steps"))
    least = min(lengths)
    true = long_enough(extract_windows(df.withColumn("_e", F.col("empty") == 1), keys, "_e", least))
    pred = long_enough(extract_windows(df, keys, "rec", least, {"safe": F.min("empty").alias("safe")}))
    other = pred.select(*keys, "min_steps", F.col("start_step").alias("_s"), F.col("end_step_excl").alias("_e"))
    place = [*keys, "min_steps", "start_step"]
    hit = true.join(other, [*keys, "min_steps"]).where(F.greatest("start_step", "_s") < F.least("end_step_excl", "_e")).select(*place).distinct().withColumn("detected", F.lit(1))
    return true.join(hit, place, "left").withColumn("detected", F.coalesce("detected", F.lit(0))), pred


def conflict_severity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each recommended window with occupied steps: how long, how much load, and in which thirds."""
    w = Window.partitionBy(*keys).orderBy("step")
    on = df.where("rec").withColumn("_w", F.col("step") - F.row_number().over(w))
    inside = Window.partitionBy(*keys, "_w").orderBy("step")
    on = on.withColumn("_i", F.row_number().over(inside) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "_w")))
    occupied = on.where("empty = 0").withColumn("_r", F.col("_i") - F.row_number().over(inside))
    third = 3 * (2 * F.col("_i") + 1)  # integers: no rounding at the edges
    flags = {"begin": third < 2 * F.col("_n"), "middle": (third >= 2 * F.col("_n")) & (third < 4 * F.col("_n")), "end": third >= 4 * F.col("_n")}
    runs = occupied.groupBy(*keys, "_w", "_n", "_r").agg(
        F.count("*").alias("run"), F.sum("kwh").alias("kwh"), F.min(F.col("step") - F.col("_i")).alias("start_step"),
        F.collect_list("step").alias("steps"), *(F.max(c.cast("int")).alias(n) for n, c in flags.items()),
    )
    whole = runs.groupBy(*keys, "_w", "_n").agg(
        F.min("start_step").alias("start_step"), F.sum("run").alias("occupied_intervals"), F.max("run").alias("longest_run"), F.sum("kwh").alias("conflict_kwh"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("steps"))), lambda s: s.cast("string")), "|").alias("occupied_steps"),
        *(F.max(n).alias(f"conflict_{n}") for n in flags),
    )
    return whole.select(
        *keys, "start_step", F.col("_n").alias("window_intervals"), "occupied_intervals", (15 * F.col("occupied_intervals")).alias("occupied_minutes"),
        (15 * F.col("longest_run")).alias("longest_minutes"), "conflict_kwh", (100.0 * F.col("occupied_intervals") / F.col("_n")).alias("percent_occupied"),
        "occupied_steps", *(f"conflict_{n}" for n in flags),
    )
