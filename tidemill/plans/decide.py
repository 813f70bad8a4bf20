"""Queries: stable windows, policy accounting, sweeps, selection and search grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.operators import metrics as M
from tidemill.operators import policy as P
from tidemill.operators import windows as W
from tidemill.plans import base
from tidemill.plans.base import sql
from tidemill.plans.prepare import ASSUMED, WEIGHTED, weighted_kwh
from tidemill.plans.registry import query

HK = ["entity_id", "model", "anchor_pos"]
SWEEP_DOUBLES = "threshold coverage conflict_rate empty_recall gross_kwh safe_kwh"


def midnight(spark, d, splits=("val", "test"), models=(*base.MODELS, "blend")):
    return base.long(base.wide(spark, d, midnight=True, splits=splits), models)


def opened(spark, d, splits=("val", "test"), length=4):
    return W.opening(midnight(spark, d, splits), HK, length)


def swept(spark, d, splits=("val", "test")):
    return P.sweep(opened(spark, d, splits), ["entity_id", "split", "model"], ["anchor_pos"])


def chosen(spark, d, legacy=False):
    return P.select_constrained(swept(spark, d, ("val",)), ["entity_id", "model"], legacy=legacy)


@base.once
def masked(spark, d):
    """Test steps under each selected threshold."""
    pick = chosen(spark, d).select("entity_id", "model", "delta", "met", "thr_idx", "threshold")
    return opened(spark, d, ("test",)).join(pick, ["entity_id", "model"]).withColumn("rec", F.coalesce(F.col("opening") >= F.col("threshold") - 1e-11, F.lit(False)))


@query("threshold_grid", sql("SELECT thr_idx, threshold, count(p) AS scores_at_or_above FROM grid LEFT JOIN (SELECT * FROM long_mid WHERE split = 'val') ON p >= threshold - 1e-11 GROUP BY 1, 2", "grid", "long_mid"), "threshold")
def _(spark, d):
    """All thresholds with the number of validation scores that reach each."""
    scores = midnight(spark, d, ("val",)).withColumn("opening", F.col("p"))
    reached = scores.groupBy(P.level().alias("level")).agg(F.count("*").alias("n"))  # at most one row a threshold
    grid = P.threshold_grid(spark).join(F.broadcast(reached), F.col("level") >= F.col("thr_idx"), "left")
    return grid.groupBy("thr_idx", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scores_at_or_above"))


@query("stable_mask", sql("SELECT entity_id, model, anchor_pos, step::INTEGER AS step, p, coalesce(opening >= 0.8 - 1e-11, FALSE)::INTEGER AS rec FROM opened", "opened"), "p")
def _(spark, d):
    m = W.stable_mask(midnight(spark, d), HK, 0.8 - 1e-11)
    return m.select(*HK, "step", "p", F.col("rec").cast("int").alias("rec"))


@query("stable_mask_islands", sql("SELECT entity_id, model, anchor_pos, step::INTEGER AS step FROM opened WHERE opening >= 0.8 - 1e-11", "opened"))
def _(spark, d):
    flagged = midnight(spark, d).withColumn("high", F.col("p") >= 0.8 - 1e-11)
    runs = W.extract_windows(flagged, HK, "high", 4)
    return runs.select(*HK, F.explode(F.sequence("start_step", F.col("end_step_excl") - 1)).alias("step"))


RUNS = "SELECT entity_id, model, delta, anchor_pos, row_number() OVER (PARTITION BY entity_id, model, delta, anchor_pos ORDER BY start_step)::INTEGER AS window_no, start_step::INTEGER AS start_step, end_step_excl::INTEGER AS end_step_excl, length FROM runs"


@query("extract_windows", sql(RUNS, "runs"), "delta")
def _(spark, d):
    return W.extract_windows(masked(spark, d), ["entity_id", "model", "delta", "anchor_pos"])


SUMMARY = """SELECT entity_id, model, delta, count(*) AS recommended_windows, count(*) FILTER (safe = 1) AS safe_windows, count(*) FILTER (safe = 0) AS conflict_windows,
  count(*) FILTER (safe = 0) / count(*) AS window_conflict_rate, avg(length * 0.25) AS avg_window_hours, sum(length * 0.25)::DOUBLE AS total_window_hours, coalesce(avg(length * 0.25) FILTER (safe = 1), 0) AS avg_safe_window_hours FROM runs GROUP BY 1, 2, 3"""
SUMMARY_DOUBLES = "delta window_conflict_rate avg_window_hours total_window_hours avg_safe_window_hours"


@query("window_summary", sql(SUMMARY, "runs"), SUMMARY_DOUBLES)
def _(spark, d):
    return W.window_summary(masked(spark, d), ["entity_id", "model", "delta"], ["entity_id", "model", "delta", "anchor_pos"])


def window_level(least):
    truth = f"""(SELECT entity_id, model, anchor_pos, min(step) AS s, max(step) + 1 AS e FROM (SELECT *, step - row_number() OVER (PARTITION BY entity_id, model, anchor_pos ORDER BY step) AS i FROM opened WHERE empty = 1 AND split = 'test') GROUP BY entity_id, model, anchor_pos, i HAVING count(*) >= {least})"""
    pred = f"""(SELECT entity_id, model, anchor_pos, min(step) AS s, max(step) + 1 AS e, min(empty) AS safe FROM (SELECT *, step - row_number() OVER (PARTITION BY entity_id, model, anchor_pos ORDER BY step) AS i FROM opened WHERE p >= 0.8 - 1e-11 AND split = 'test') GROUP BY entity_id, model, anchor_pos, i HAVING count(*) >= {least})"""
    return f"""SELECT {least} AS min_steps, t.entity_id, t.model, true_windows, detected_windows, coalesce(predicted_windows, 0)::BIGINT AS predicted_windows, coalesce(safe_windows, 0)::BIGINT AS safe_windows, coalesce(hours, 0) AS mean_hours FROM
      (SELECT entity_id, model, count(*) AS true_windows, count(*) FILTER (EXISTS (SELECT 1 FROM {pred} p WHERE p.entity_id = t.entity_id AND p.model = t.model AND p.anchor_pos = t.anchor_pos AND greatest(p.s, t.s) < least(p.e, t.e))) AS detected_windows FROM {truth} t GROUP BY 1, 2) t
      LEFT JOIN (SELECT entity_id, model, count(*) AS predicted_windows, count(*) FILTER (safe = 1) AS safe_windows, avg((e - s) * 0.25) AS hours FROM {pred} GROUP BY 1, 2) p ON p.entity_id = t.entity_id AND p.model = t.model"""


@query("window_level_metrics", sql(" UNION ALL ".join(window_level(k) for k in (4, 8, 16)), "opened"), "mean_hours")
def _(spark, d):
    flagged = midnight(spark, d, ("test",)).withColumn("rec", F.col("p") >= 0.8 - 1e-11)
    true, pred = W.detected_windows(flagged, HK, (4, 8, 16))
    by = ["entity_id", "model", "min_steps"]
    true = true.groupBy(*by).agg(F.count("*").alias("true_windows"), F.count_if(F.col("detected") == 1).alias("detected_windows"))
    pred = pred.groupBy(*by).agg(F.count("*").alias("predicted_windows"), F.count_if(F.col("safe") == 1).alias("safe_windows"), F.avg(F.col("length") * 0.25).alias("mean_hours"))
    return true.join(pred, by, "left").fillna(0)


SEVERITY = """SELECT entity_id, model, delta, anchor_pos, min(step - i)::INTEGER AS start_step, any_value(n)::BIGINT AS window_intervals, count(*)::BIGINT AS occupied_intervals, (15 * count(*))::BIGINT AS occupied_minutes, (15 * max(run))::BIGINT AS longest_minutes,
  sum(kwh) AS conflict_kwh, 100 * count(*) / any_value(n) AS percent_occupied, string_agg(step::VARCHAR, '|' ORDER BY step) AS occupied_steps,
  max((3 * (2 * i + 1) < 2 * n)::INTEGER) AS conflict_begin, max((3 * (2 * i + 1) >= 2 * n AND 3 * (2 * i + 1) < 4 * n)::INTEGER) AS conflict_middle, max((3 * (2 * i + 1) >= 4 * n)::INTEGER) AS conflict_end
FROM (SELECT *, count(*) OVER (PARTITION BY entity_id, model, delta, anchor_pos, island, r) AS run FROM (
  SELECT *, i - row_number() OVER (PARTITION BY entity_id, model, delta, anchor_pos, island ORDER BY step) AS r FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_id, model, delta, anchor_pos, island ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY entity_id, model, delta, anchor_pos, island) AS n FROM islands) WHERE empty = 0))
GROUP BY entity_id, model, delta, anchor_pos, island"""


@query("conflict_severity", sql(SEVERITY, "islands"), "delta conflict_kwh percent_occupied")
def _(spark, d):
    return W.conflict_severity(masked(spark, d), ["entity_id", "model", "delta", "anchor_pos"])


@query("conflict_thirds", sql(f"SELECT entity_id, model, delta, count(*) AS windows, sum(conflict_begin)::BIGINT AS begins, sum(conflict_middle)::BIGINT AS middles, sum(conflict_end)::BIGINT AS ends FROM ({SEVERITY}) GROUP BY 1, 2, 3", "islands"), "delta")
def _(spark, d):
    s = W.conflict_severity(masked(spark, d), ["entity_id", "model", "delta", "anchor_pos"])
    return s.groupBy("entity_id", "model", "delta").agg(F.count("*").alias("windows"), *(F.sum(f"conflict_{a}").alias(b) for a, b in (("begin", "begins"), ("middle", "middles"), ("end", "ends"))))


def sensitivity(length):
    return f"""SELECT {length} AS min_steps, entity_id, model, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh FROM (
      SELECT *, count(*) FILTER (high) OVER (PARTITION BY entity_id, model, anchor_pos, i) >= {length} AND high AS rec FROM (SELECT o.*, p >= threshold - 1e-11 AS high, step - sum((p >= threshold - 1e-11)::INTEGER) OVER (PARTITION BY o.entity_id, o.model, o.anchor_pos ORDER BY step) AS i
        FROM opened o JOIN chosen c USING (entity_id, model) WHERE o.split = 'test' AND delta = 0.1)) GROUP BY entity_id, model"""


LENGTHS = (1, 2, 4, 8, 16)


@query("stable_window_sensitivity", sql(" UNION ALL ".join(sensitivity(k) for k in LENGTHS), "chosen"), "safe_kwh")
def _(spark, d):
    pick = chosen(spark, d).where("delta = 0.1").select("entity_id", "model", "threshold")
    rows = midnight(spark, d, ("test",)).join(pick, ["entity_id", "model"])
    m = W.openings(rows, HK, LENGTHS).withColumn("rec", F.coalesce(F.col("opening") >= F.col("threshold") - 1e-11, F.lit(False)))
    return M.policy_rows(m, ["min_steps", "entity_id", "model"], ["anchor_pos"]).select("min_steps", "entity_id", "model", "recommended_intervals", "safe_intervals", "safe_kwh")


POLICY = """SELECT entity_id, model, delta, any_value(met) AS met, any_value(threshold) AS threshold, count(DISTINCT anchor_pos) AS daily_schedules, count(*) AS total_intervals, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals,
  count(*) FILTER (rec AND empty = 0) AS conflict_intervals, count(*) FILTER (rec) / count(*) AS coverage, coalesce(count(*) FILTER (rec AND empty = 0) / nullif(count(*) FILTER (rec), 0), 0) AS conflict_rate,
  coalesce(count(*) FILTER (rec AND empty = 1) / nullif(count(*) FILTER (empty = 1), 0), 0) AS empty_recall, coalesce(sum(kwh) FILTER (rec), 0) AS gross_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh,
  coalesce(sum(kwh) FILTER (rec AND empty = 0), 0) AS conflict_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) / greatest(count(DISTINCT anchor_pos), 1) AS kwh_per_day FROM masked GROUP BY 1, 2, 3"""
POLICY_DOUBLES = "delta threshold coverage conflict_rate empty_recall gross_kwh safe_kwh conflict_kwh kwh_per_day"


def evaluated(spark, d):
    """Selected thresholds on test horizons: policy rows with their window summary."""
    m = masked(spark, d)
    group = ["entity_id", "model", "delta", "met", "threshold"]
    windows = W.window_summary(m, ["entity_id", "model", "delta"], ["entity_id", "model", "delta", "anchor_pos"])
    rows = M.policy_rows(m, group, ["anchor_pos"])
    return rows.join(windows, ["entity_id", "model", "delta"], "left").fillna(0)


EVALUATED = f"SELECT p.*, " + ", ".join(f"coalesce({c}, 0)::{t} AS {c}" for c, t in (("recommended_windows", "BIGINT"), ("safe_windows", "BIGINT"), ("conflict_windows", "BIGINT"), ("window_conflict_rate", "DOUBLE"), ("avg_window_hours", "DOUBLE"), ("total_window_hours", "DOUBLE"), ("avg_safe_window_hours", "DOUBLE"))) + f" FROM ({POLICY}) p LEFT JOIN ({SUMMARY}) USING (entity_id, model, delta)"
EVALUATED_DOUBLES = POLICY_DOUBLES + SUMMARY_DOUBLES.removeprefix("delta")

query("flagship_policy", sql(EVALUATED, "runs", "masked"), EVALUATED_DOUBLES)(evaluated)
query("evaluate_selected", sql(EVALUATED, "runs", "masked"), EVALUATED_DOUBLES)(evaluated)


@query("policy_row", sql(POLICY, "masked"), POLICY_DOUBLES)
def _(spark, d):
    return M.policy_rows(masked(spark, d), ["entity_id", "model", "delta", "met", "threshold"], ["anchor_pos"])


@query("confusion_policy", sql("SELECT entity_id, model, count(*) FILTER (rec AND empty = 1) AS tp, count(*) FILTER (rec AND empty = 0) AS fp, count(*) FILTER (NOT rec AND empty = 1) AS fn, count(*) FILTER (NOT rec AND empty = 0) AS tn FROM masked WHERE delta = 0.1 GROUP BY 1, 2", "masked"))
def _(spark, d):
    y, r = F.col("empty") == 1, F.col("rec")
    return masked(spark, d).where("delta = 0.1").groupBy("entity_id", "model").agg(F.count_if(r & y).alias("tp"), F.count_if(r & ~y).alias("fp"), F.count_if(~r & y).alias("fn"), F.count_if(~r & ~y).alias("tn"))


@query("recommendation_metrics", sql("SELECT entity_id, model, delta, count(*) FILTER (rec) / count(*) AS rate, coalesce(count(*) FILTER (rec AND empty = 0) / nullif(count(*) FILTER (empty = 0), 0), 0) AS fpr, coalesce(count(*) FILTER (NOT rec AND empty = 1) / nullif(count(*) FILTER (empty = 1), 0), 0) AS missed_rate, coalesce(count(*) FILTER (rec AND empty = 1) / nullif(count(*) FILTER (rec), 0), 0) AS precision FROM masked GROUP BY 1, 2, 3", "masked"), "delta rate fpr missed_rate precision")
def _(spark, d):
    y, r = F.col("empty") == 1, F.col("rec")
    return masked(spark, d).groupBy("entity_id", "model", "delta").agg((F.count_if(r) / F.count("*")).alias("rate"), M.ratio(F.count_if(r & ~y), F.count_if(~y)).alias("fpr"), M.ratio(F.count_if(~r & y), F.count_if(y)).alias("missed_rate"), M.ratio(F.count_if(r & y), F.count_if(r)).alias("precision"))


@query("energy_metrics", sql("SELECT entity_id, model, delta, coalesce(sum(kwh) FILTER (rec), 0) AS gross_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh, coalesce(sum(kwh) FILTER (empty = 1), 0) AS available_kwh, coalesce(coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) / nullif(sum(kwh) FILTER (empty = 1), 0), 0) AS capture_rate FROM masked GROUP BY 1, 2, 3", "masked"), "delta gross_kwh safe_kwh available_kwh capture_rate")
def _(spark, d):
    y, r = F.col("empty") == 1, F.col("rec")
    kwh = lambda c: F.coalesce(F.sum(F.when(c, F.col("kwh"))), F.lit(0.0))
    return masked(spark, d).groupBy("entity_id", "model", "delta").agg(kwh(r).alias("gross_kwh"), kwh(r & y).alias("safe_kwh"), kwh(y).alias("available_kwh"), M.ratio(kwh(r & y), kwh(y)).alias("capture_rate"))


@query("zero_event_bound", sql(f"SELECT entity_id, model, delta, unit, n, 1 - pow(0.05, 1 / n) AS bound FROM (SELECT entity_id, model, delta, 'interval' AS unit, count(*) FILTER (rec) AS n FROM masked GROUP BY 1, 2, 3 UNION ALL SELECT entity_id, model, delta, 'window', count(*) FROM runs GROUP BY 1, 2, 3) WHERE n > 0", "masked", "runs"), "delta bound")
def _(spark, d):
    m, by = masked(spark, d), ["entity_id", "model", "delta"]
    intervals = m.groupBy(*by).agg(F.count_if("rec").alias("n")).select(*by, F.lit("interval").alias("unit"), "n")
    windows = W.extract_windows(m, [*by, "anchor_pos"]).groupBy(*by).agg(F.count("*").alias("n")).select(*by, F.lit("window").alias("unit"), "n")
    return intervals.unionByName(windows).where("n > 0").withColumn("bound", M.zero_event_bound(F.col("n")))


@query("control_scenarios", sql(f"SELECT entity_id, model, scenario, safe_kwh * share AS scenario_kwh, safe_kwh * share / daily_schedules AS kwh_per_day FROM ({POLICY}) JOIN (VALUES ('full', 1.0::DOUBLE), ('half', 0.5::DOUBLE), ('quarter', 0.25::DOUBLE)) s(scenario, share) ON TRUE WHERE delta = 0.1", "masked"), "scenario_kwh kwh_per_day")
def _(spark, d):
    rows = M.policy_rows(masked(spark, d).where("delta = 0.1"), ["entity_id", "model"], ["anchor_pos"])
    both = rows.join(F.broadcast(spark.createDataFrame(S.CONTROL_SCENARIOS, "scenario string, share double")))
    return both.select("entity_id", "model", "scenario", (F.col("safe_kwh") * F.col("share")).alias("scenario_kwh"), (F.col("safe_kwh") * F.col("share") / F.col("daily_schedules")).alias("kwh_per_day"))


@query("threshold_sweep", sql("SELECT * FROM swept", "swept"), SWEEP_DOUBLES)
def _(spark, d):
    return swept(spark, d)


SELECTED = "SELECT entity_id, model, delta, met, thr_idx, threshold, conflict_rate, safe_kwh FROM chosen"


@query("select_constrained", sql(SELECTED, "chosen"), "delta threshold conflict_rate safe_kwh")
def _(spark, d):
    return chosen(spark, d).select("entity_id", "model", "delta", "met", "thr_idx", "threshold", "conflict_rate", "safe_kwh")


PARETO = """SELECT entity_id, split, model, thr_idx, (best = 1 AND coalesce(g > max(g) OVER (PARTITION BY entity_id, split, model ORDER BY c RANGE BETWEEN UNBOUNDED PRECEDING AND 1e-9 PRECEDING), TRUE))::INTEGER AS efficient
FROM (SELECT *, round(conflict_rate, 9) AS c, round(safe_kwh, 6) AS g, row_number() OVER (PARTITION BY entity_id, split, model, round(conflict_rate, 9) ORDER BY round(safe_kwh, 6) DESC, thr_idx) AS best FROM swept)"""


@query("pareto_front", sql(PARETO, "swept"))
def _(spark, d):
    return P.pareto_front(swept(spark, d), ["entity_id", "split", "model"]).select("entity_id", "split", "model", "thr_idx", "efficient")


TUPLES = "SELECT entity_id, slot, persist, recent, sum(empty) AS tp, count(*) AS n FROM wide_all WHERE split = 'val' GROUP BY ALL"
GRID_AP = """SELECT entity_id, grid_order, coalesce(sum(tp * ct / (ct + cf)) / nullif(sum(tp), 0), 0) AS average_precision FROM (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM (
  SELECT entity_id, grid_order, round(w1 * slot + w2 * persist + w3 * recent, 12) AS s, sum(tp)::DOUBLE AS tp, sum(n - tp)::DOUBLE AS fp FROM tuples JOIN blends ON TRUE GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY entity_id, grid_order ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2"""
SIMPLEX = "SELECT (row_number() OVER (ORDER BY i, j) - 1)::INTEGER AS grid_order, i / {n} AS w1, j / {n} AS w2, ({n} - i - j) / {n} AS w3, ((i > 0)::INTEGER + (j > 0)::INTEGER + ({n} - i - j > 0)::INTEGER) AS nonzero FROM range({m}) a(i) JOIN range({m}) b(j) ON i + j <= {n}"


@query("simplex_grid", sql("", "wide_mid") + f", blends AS MATERIALIZED ({SIMPLEX.format(n=20, m=21)})\nSELECT b.*, m.entity_id, round(w1 * m.slot + w2 * m.persist + w3 * m.recent + 1e-8, 6) AS mean_score FROM blends b JOIN (SELECT entity_id, avg(slot) AS slot, avg(persist) AS persist, avg(recent) AS recent FROM wide_mid WHERE split = 'val' GROUP BY 1) m ON TRUE", "w1 w2 w3 mean_score")
def _(spark, d):
    """All weights of the three scores, with the mean validation score of each blend."""
    means = base.wide(spark, d, midnight=True, splits=("val",)).groupBy("entity_id").agg(*(F.avg(c).alias(c) for c in COLS))
    grid = means.join(F.broadcast(P.simplex_grid(spark, P.step_parts(0.05))))
    return grid.withColumn("mean_score", F.round(sum(F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(COLS)) + 1e-8, 6)).drop(*COLS)


def with_grid(n):
    return sql("", "wide_all") + f", tuples AS MATERIALIZED ({TUPLES}), blends AS MATERIALIZED ({SIMPLEX.format(n=n, m=n + 1)})\n"


COLS = ["slot", "persist", "recent"]


def validation(spark, d):
    return base.wide(spark, d, splits=("val",))


@query("blend_grid_3d", with_grid(20) + f"SELECT entity_id, grid_order, average_precision, row_number() OVER (PARTITION BY entity_id ORDER BY round(average_precision, 9) DESC, grid_order)::INTEGER AS place FROM ({GRID_AP})", "average_precision")
def _(spark, d):
    ap = P.blend_grid(validation(spark, d), P.simplex_grid(spark, 20), COLS, ["entity_id"])
    return ap.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc(F.round("average_precision", 9)), "grid_order")))


LINE = "SELECT k::INTEGER AS grid_order, k / 100 AS w1, (100 - k) / 100 AS w2, 0 AS w3 FROM range(101) r(k)"


@query("blend_grid_1d", sql("", "wide_all") + f", tuples AS MATERIALIZED ({TUPLES}), blends AS MATERIALIZED ({LINE})\nSELECT * FROM ({GRID_AP}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(average_precision, 9) DESC, grid_order) = 1", "average_precision")
def _(spark, d):
    line = spark.range(101).select(F.col("id").cast("int").alias("grid_order"), (F.col("id") / 100).alias("w1"), ((100 - F.col("id")) / 100).alias("w2"))
    ap = P.blend_grid(validation(spark, d), line, COLS[:2], ["entity_id"])
    return P.top_one(ap, ["entity_id"], [F.desc(F.round("average_precision", 9)), F.asc("grid_order")])


PARTS = P.step_parts(0.05)
#: The conflict limit of the searches, and a stricter one.
LIMIT, STRICT_LIMIT = 0.10, 0.05
ENTITY = ["entity_id"]


def joint(spark, d, parts=PARTS):
    """Blend and threshold grid on validation: average precision over all rows, policy and windows over midnight rows.

    No pass for each threshold: policies and windows come from histograms of openings.
    """
    grid = P.simplex_grid(spark, parts)
    ap = P.blend_grid(validation(spark, d), grid, COLS, ENTITY)
    rows = base.wide(spark, d, midnight=True, splits=("val",)).join(F.broadcast(grid))
    rows = rows.withColumn("p", F.round(sum(F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(COLS)), 12)).select(*ENTITY, "grid_order", "anchor_pos", "step", "empty", "kwh", "p")
    keys = [*ENTITY, "grid_order", "anchor_pos"]
    at = W.opening(rows, keys)
    group = [*ENTITY, "grid_order"]
    full = P.sweep(at, group, ["anchor_pos"]).join(P.window_sweep(at, group, keys), [*group, "thr_idx"]).join(ap, group)
    full = full.join(F.broadcast(grid.select("grid_order", "w1", "w2", "w3", "nonzero")), "grid_order")
    return full.withColumn("blend_order", F.col("grid_order")).withColumn("grid_order", F.col("blend_order") * P.THRESHOLDS + F.col("thr_idx"))


@base.once
def joint_table(spark, d):
    """The whole joint grid; its size is that of the grids, for each entity."""
    return joint(spark, d)


JOINT = sql("", "wide_mid", "grid") + f""", tuples AS MATERIALIZED ({TUPLES}), blends AS MATERIALIZED ({SIMPLEX.format(n=PARTS, m=PARTS + 1)}), aps AS MATERIALIZED ({GRID_AP}),
blended AS MATERIALIZED (SELECT entity_id, grid_order AS g, anchor_pos, step, empty, kwh, round(w1 * slot + w2 * persist + w3 * recent, 12) AS p FROM wide_mid JOIN blends ON TRUE WHERE split = 'val'),
lows AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w = 4 THEN min(p) OVER w END AS low FROM blended WINDOW w AS (PARTITION BY entity_id, g, anchor_pos ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
raised AS MATERIALIZED (SELECT *, max(low) OVER (PARTITION BY entity_id, g, anchor_pos ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS opening FROM lows),
tried AS MATERIALIZED (SELECT a.*, thr_idx, threshold, coalesce(opening >= threshold - 1e-11, FALSE) AS rec FROM raised a JOIN grid ON TRUE),
pol AS MATERIALIZED (SELECT entity_id, g, thr_idx, any_value(threshold) AS threshold, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec) / count(*) AS coverage, coalesce(count(*) FILTER (rec AND empty = 0) / nullif(count(*) FILTER (rec), 0), 0) AS conflict_rate, coalesce(count(*) FILTER (rec AND empty = 1) / nullif(count(*) FILTER (empty = 1), 0), 0) AS empty_recall, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh FROM tried GROUP BY 1, 2, 3),
isl AS MATERIALIZED (SELECT *, step - row_number() OVER (PARTITION BY entity_id, g, thr_idx, anchor_pos ORDER BY step) AS i FROM tried WHERE rec),
win AS MATERIALIZED (SELECT entity_id, g, thr_idx, count(*) AS rw, count(*) FILTER (safe = 1) AS sw FROM (SELECT entity_id, g, thr_idx, anchor_pos, i, min(empty) AS safe FROM isl GROUP BY ALL) GROUP BY 1, 2, 3),
joint AS MATERIALIZED (SELECT entity_id, g AS blend_order, thr_idx, (g * 37 + thr_idx)::INTEGER AS grid_order, threshold, recommended_intervals, coverage, conflict_rate, empty_recall, safe_kwh, coalesce(rw, 0)::BIGINT AS recommended_windows, coalesce(sw, 0)::BIGINT AS safe_windows, average_precision, w1, w2, w3, nonzero
  FROM pol LEFT JOIN win USING (entity_id, g, thr_idx) JOIN aps a USING (entity_id) JOIN blends b ON b.grid_order = g WHERE a.grid_order = g)
"""
JOINT_COLS = ["entity_id", "grid_order", "threshold", "recommended_intervals", "coverage", "conflict_rate", "empty_recall", "safe_kwh", "recommended_windows", "safe_windows", "average_precision", "w1", "w2", "w3", "nonzero"]
JOINT_DOUBLES = "threshold coverage conflict_rate empty_recall safe_kwh average_precision w1 w2 w3"


def joint_grid(spark, d):
    return joint_table(spark, d).select(*JOINT_COLS)


query("joint_grid", JOINT + f"SELECT {', '.join(JOINT_COLS)} FROM joint", JOINT_DOUBLES)(joint_grid)


def joint_pick(floor, limit):
    more = "" if floor is None else f"AND round(average_precision, 9) >= round(best_ap * {floor}, 9)"
    return f"""SELECT entity_id, grid_order FROM (SELECT *, max(average_precision) OVER (PARTITION BY entity_id) AS best_ap FROM joint) WHERE round(conflict_rate, 9) <= {limit} AND recommended_windows >= 1 AND coverage > 0 {more}
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(safe_kwh, 6) DESC, round(conflict_rate, 9), round(average_precision, 9) DESC, safe_windows DESC, nonzero, grid_order) = 1"""


def fixed_pick(which, limit):
    """The threshold of one blend: within the limit the most safe load, else the least conflict."""
    met = f"(round(conflict_rate, 9) <= {limit})::INTEGER"
    return f"""SELECT entity_id, grid_order FROM joint {which} QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {met} DESC, CASE {met} WHEN 1 THEN -round(safe_kwh, 6) ELSE round(conflict_rate, 9) END,
      CASE {met} WHEN 1 THEN -round(empty_recall, 9) ELSE -round(safe_kwh, 6) END, grid_order) = 1"""


TOP_BLEND = "JOIN (SELECT entity_id, blend_order FROM (SELECT DISTINCT entity_id, blend_order, average_precision FROM joint) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY round(average_precision, 9) DESC, blend_order) = 1) USING (entity_id, blend_order)"


def role_pick(source, floor, limit):
    if source == "joint":
        return joint_pick(floor, limit)
    return fixed_pick(TOP_BLEND if source == "best_blend" else f"WHERE {source} = 1", limit)


def candidates_sql(limit):
    return " UNION ALL ".join(f"SELECT '{role}' AS role, * FROM ({role_pick(source, floor, limit)})" for role, source, floor in P.ROLES)


FLOORS = (None, 0.95, 0.98, 0.99)
WINDOW_FLOORS = (0.0, 0.70, 0.80, 0.85, 0.90)
PAIRS = ", ".join(f"({i * 4 + j}, {w}::DOUBLE, {'NULL' if a is None else a}::DOUBLE)" for i, w in enumerate(WINDOW_FLOORS) for j, a in enumerate(FLOORS))
FLAGS = ["meets_conflict", "meets_windows", "meets_ap", "has_window", "has_coverage", "feasible"]


def constrained_sql(limit):
    return f"""SELECT *, least(meets_conflict, meets_windows, meets_ap, has_window, has_coverage) AS feasible FROM (
  SELECT j.*, constraint_order, window_floor, ap_floor, (round(conflict_rate, 9) <= {limit})::INTEGER AS meets_conflict, (round(safe_window_rate, 9) >= window_floor)::INTEGER AS meets_windows,
    (ap_floor IS NULL OR round(average_precision, 9) >= round(best_ap * ap_floor, 9))::INTEGER AS meets_ap, (recommended_windows >= 1)::INTEGER AS has_window, (coverage > 0)::INTEGER AS has_coverage
  FROM (SELECT *, max(average_precision) OVER (PARTITION BY entity_id) AS best_ap, coalesce(safe_windows / nullif(recommended_windows, 0), 0) AS safe_window_rate FROM joint) j JOIN (VALUES {PAIRS}) c(constraint_order, window_floor, ap_floor) ON TRUE)"""


def aware_sql(limit):
    return f"SELECT * FROM ({constrained_sql(limit)}) WHERE feasible = 1 QUALIFY row_number() OVER (PARTITION BY entity_id, constraint_order ORDER BY round(safe_kwh, 6) DESC, round(safe_window_rate, 9) DESC, round(conflict_rate, 9), round(average_precision, 9) DESC, safe_windows DESC, nonzero, grid_order) = 1"


def dedupe_sql(limit):
    return f"SELECT entity_id, grid_order, coalesce(max(constraint_order) FILTER (constraint_order = 15), min(constraint_order)) AS representative, string_agg(constraint_order::VARCHAR, '|' ORDER BY constraint_order) AS rules FROM ({aware_sql(limit)}) GROUP BY 1, 2"


UNION_COLS = JOINT_COLS[2:]


def union_sql(limit):
    ids = f"SELECT 'window_aware' AS kind, entity_id, constraint_order, NULL::VARCHAR AS role, grid_order FROM ({aware_sql(limit)}) UNION ALL SELECT 'reference', entity_id, NULL, role, grid_order FROM ({candidates_sql(limit)})"
    return f"SELECT kind, u.entity_id, constraint_order, role, u.grid_order, {', '.join(UNION_COLS)} FROM ({ids}) u JOIN joint j ON j.entity_id = u.entity_id AND j.grid_order = u.grid_order"


def constrained(grid, limit):
    """All pairs of floors for each entity of a joint grid."""
    return P.constraint_grid(grid, WINDOW_FLOORS, FLOORS, limit, ENTITY)


def window_aware(grid, limit):
    return P.select_window_aware(constrained(grid, limit), ENTITY)


def references(grid, limit):
    """Window-aware picks and the candidate set of each entity of a joint grid, with their rows; what one kind lacks is null."""
    own = [c for c in UNION_COLS if c in grid.columns]
    new = window_aware(grid, limit).select(F.lit("window_aware").alias("kind"), *ENTITY, "constraint_order", "grid_order", *own)
    old = P.candidate_set(grid, ENTITY, limit).select(F.lit("reference").alias("kind"), *ENTITY, "role", "grid_order", *own)
    return new.unionByName(old, allowMissingColumns=True)


#: Searches of every entity on the grid of .05 under both limits.  A limit that no blend keeps gives no pick.
SEARCHES = {
    "select_joint": (lambda g, x: P.select_joint(g, ENTITY, 0.99, x).select(*ENTITY, "grid_order"), lambda x: joint_pick(0.99, x)),
    "candidate_set": (lambda g, x: P.candidate_set(g, ENTITY, x).select("role", *ENTITY, "grid_order"), candidates_sql),
    "constraint_grid": (lambda g, x: constrained(g, x).select(*ENTITY, "constraint_order", "grid_order", *FLAGS), lambda x: f"SELECT entity_id, constraint_order, grid_order, {', '.join(FLAGS)} FROM ({constrained_sql(x)})"),
    "select_window_aware": (lambda g, x: window_aware(g, x).select(*ENTITY, "constraint_order", "grid_order"), lambda x: f"SELECT entity_id, constraint_order, grid_order FROM ({aware_sql(x)})"),
    "dedupe_strategies": (lambda g, x: P.dedupe_strategies(window_aware(g, x), ENTITY), dedupe_sql),
    "reference_union": (references, union_sql),
}
for _name, (_search, _sql) in SEARCHES.items():
    for _suffix, _limit in (("", LIMIT), ("_fine", STRICT_LIMIT)):
        query(_name + _suffix, JOINT + _sql(_limit), JOINT_DOUBLES if _name == "reference_union" else "")(lambda spark, d, f=_search, x=_limit: f(joint_table(spark, d), x))
query("joint_grid_fine", JOINT + f"SELECT {', '.join(JOINT_COLS)} FROM joint", JOINT_DOUBLES)(joint_grid)


@base.once
def frozen_candidates(spark, d):
    """The candidate set as frozen strategies; a few rows for each entity."""
    return P.freeze(P.candidate_set(joint_table(spark, d), ENTITY, LIMIT), F.col("role"), ENTITY)


def held_out(spark, d):
    """(all test rows, midnight test rows)."""
    return base.wide(spark, d, splits=("test",)), base.wide(spark, d, midnight=True, splits=("test",))


def frozen_sql(limit):
    """Common table expressions: frozen strategies, their scores over all test rows, and their policy, windows and conflicts."""
    return JOINT + f""", frozen AS MATERIALIZED (SELECT entity_id, role AS strategy, w1, w2, w3, threshold FROM ({candidates_sql(limit)}) JOIN joint USING (entity_id, grid_order)),
fscored AS MATERIALIZED (SELECT entity_id, strategy, empty, round(w1 * slot + w2 * persist + w3 * recent, 12) AS p FROM wide_all JOIN frozen USING (entity_id) WHERE split = 'test'),
fap AS MATERIALIZED (SELECT entity_id, strategy, coalesce(sum(tp * ct / (ct + cf)) / nullif(sum(tp), 0), 0) AS average_precision FROM (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM (
  SELECT entity_id, strategy, p, sum(empty)::DOUBLE AS tp, sum(1 - empty)::DOUBLE AS fp FROM fscored GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY entity_id, strategy ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) GROUP BY 1, 2),
flow AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w = 4 THEN min(p) OVER w END AS low FROM (SELECT entity_id, strategy, anchor_pos, step, empty, kwh, threshold, round(w1 * slot + w2 * persist + w3 * recent, 12) AS p FROM wide_mid JOIN frozen USING (entity_id) WHERE split = 'test')
  WINDOW w AS (PARTITION BY entity_id, strategy, anchor_pos ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
fmask AS MATERIALIZED (SELECT *, coalesce(max(low) OVER (PARTITION BY entity_id, strategy, anchor_pos ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >= threshold - 1e-11, FALSE) AS rec FROM flow),
fisl AS MATERIALIZED (SELECT *, step - row_number() OVER (PARTITION BY entity_id, strategy, anchor_pos ORDER BY step) AS i FROM fmask WHERE rec),
fwin AS MATERIALIZED (SELECT entity_id, strategy, count(*) AS rw, count(*) FILTER (safe = 1) AS sw FROM (SELECT entity_id, strategy, anchor_pos, i, min(empty) AS safe FROM fisl GROUP BY ALL) GROUP BY 1, 2),
fpol AS MATERIALIZED (SELECT entity_id, strategy, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals, count(*) FILTER (rec AND empty = 0) AS conflict_intervals, count(*) FILTER (rec) / count(*) AS coverage,
  coalesce(count(*) FILTER (rec AND empty = 0) / nullif(count(*) FILTER (rec), 0), 0) AS conflict_rate, coalesce(sum(kwh) FILTER (rec), 0) AS gross_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 0), 0) AS conflict_kwh FROM fmask GROUP BY 1, 2)
"""


FIXED = "entity_id strategy selection_split threshold average_precision recommended_intervals safe_intervals conflict_intervals coverage conflict_rate gross_kwh safe_kwh conflict_kwh recommended_windows safe_windows conflict_windows".split()
FIXED_SQL = """SELECT entity_id, strategy, 'val' AS selection_split, threshold, average_precision, recommended_intervals, safe_intervals, conflict_intervals, coverage, conflict_rate, gross_kwh, safe_kwh, conflict_kwh,
  coalesce(rw, 0)::BIGINT AS recommended_windows, coalesce(sw, 0)::BIGINT AS safe_windows, coalesce(rw - sw, 0)::BIGINT AS conflict_windows FROM frozen JOIN fap USING (entity_id, strategy) JOIN fpol USING (entity_id, strategy) LEFT JOIN fwin USING (entity_id, strategy)"""
FIXED_DOUBLES = "threshold average_precision coverage conflict_rate gross_kwh safe_kwh conflict_kwh"


@query("evaluate_fixed", frozen_sql(LIMIT) + FIXED_SQL, FIXED_DOUBLES)
def _(spark, d):
    return P.evaluate_fixed(frozen_candidates(spark, d), *held_out(spark, d), COLS, ENTITY).select(*FIXED)


HALF = "greatest(1e-6, least(1 - 1e-6, p)) >= 0.5"
DIAGNOSED = f"""SELECT f.*, coalesce(safe_windows / nullif(recommended_windows, 0), 0) AS safe_window_rate, precision, recall, f1, coalesce(longest, 0)::BIGINT AS longest_minutes, coalesce(minutes, 0)::BIGINT AS occupied_minutes FROM ({FIXED_SQL}) f
JOIN (SELECT entity_id, strategy, coalesce(tp / nullif(pp, 0), 0) AS precision, coalesce(tp / nullif(pos, 0), 0) AS recall, coalesce(2 * tp / nullif(pp + pos, 0), 0) AS f1 FROM (SELECT entity_id, strategy, count(*) FILTER ({HALF} AND empty = 1) AS tp, count(*) FILTER ({HALF}) AS pp, sum(empty) AS pos FROM fscored GROUP BY 1, 2)) USING (entity_id, strategy)
LEFT JOIN (SELECT entity_id, strategy, max(15 * n) AS longest, sum(15 * n) AS minutes FROM (SELECT entity_id, strategy, anchor_pos, i, r, count(*) AS n FROM (SELECT *, step - row_number() OVER (PARTITION BY entity_id, strategy, anchor_pos, i ORDER BY step) AS r FROM fisl WHERE empty = 0) GROUP BY ALL) GROUP BY 1, 2) USING (entity_id, strategy)"""


@query("strategy_diagnostic", frozen_sql(LIMIT) + DIAGNOSED, FIXED_DOUBLES + " safe_window_rate precision recall f1")
def _(spark, d):
    out = P.strategy_diagnostic(frozen_candidates(spark, d), *held_out(spark, d), COLS, ENTITY)
    return out.select(*FIXED, "safe_window_rate", "precision", "recall", "f1", "longest_minutes", "occupied_minutes")


@query("canonical_policy", sql(f"SELECT entity_id, model, recommended_intervals, safe_intervals, safe_kwh, CASE model WHEN 'slot' THEN 1 WHEN 'persist' THEN 2 WHEN 'recent' THEN 3 ELSE 4 END AS model_order FROM ({POLICY}) WHERE delta = 0.1", "masked"), "safe_kwh")
def _(spark, d):
    order = spark.createDataFrame([("slot", 1), ("persist", 2), ("recent", 3), ("blend", 4)], "model string, model_order int")
    rows = M.policy_rows(masked(spark, d).where("delta = 0.1"), ["entity_id", "model"], ["anchor_pos"])
    return rows.join(F.broadcast(order), "model").select("entity_id", "model", "recommended_intervals", "safe_intervals", "safe_kwh", "model_order")


@query("policy_outcome", sql(f"SELECT entity_id, model, delta, CASE WHEN met = 0 THEN 'not_met' WHEN round(conflict_rate, 9) <= delta THEN 'pass' ELSE 'violation' END AS outcome FROM ({POLICY})", "masked"), "delta")
def _(spark, d):
    rows = M.policy_rows(masked(spark, d), ["entity_id", "model", "delta", "met"], ["anchor_pos"])
    return rows.select("entity_id", "model", "delta", F.when(F.col("met") == 0, "not_met").when(F.round("conflict_rate", 9) <= F.col("delta"), "pass").otherwise("violation").alias("outcome"))


@query("load_sensitivity", sql(f"SELECT m.entity_id, model, assumption, coalesce(sum({WEIGHTED}) FILTER (rec AND m.empty = 1), 0) AS safe_kwh FROM masked m JOIN bins b ON b.entity_id = m.entity_id AND b.pos = m.target_pos JOIN {ASSUMED} ON TRUE WHERE delta = 0.1 GROUP BY 1, 2, 3", "masked"), "safe_kwh")
def _(spark, d):
    loads = weighted_kwh(base.bins(spark, d), spark).select("entity_id", F.col("pos").alias("target_pos"), "assumption", F.col("kwh").alias("load"))
    rows = masked(spark, d).where("delta = 0.1").join(loads, ["entity_id", "target_pos"])
    return rows.groupBy("entity_id", "model", "assumption").agg(F.coalesce(F.sum(F.when(F.col("rec") & (F.col("empty") == 1), F.col("load"))), F.lit(0.0)).alias("safe_kwh"))


DAYS = "SELECT entity_id, anchor_pos, count(*) FILTER (rec AND empty = 1) AS safe, count(*) FILTER (rec AND empty = 0) AS conflict, count(*) FILTER (NOT rec AND empty = 1) AS missed, sum(abs(empty - before))::BIGINT AS transitions FROM (SELECT *, coalesce(lag(empty) OVER (PARTITION BY entity_id, anchor_pos ORDER BY step), empty) AS before FROM masked WHERE delta = 0.1 AND model = 'blend') GROUP BY 1, 2"
CASES = {"success": "(safe > 0 AND conflict = 0)::INTEGER DESC, safe DESC", "conflict": "conflict DESC, 1", "missed": "missed DESC, 1", "transitions": "transitions DESC, 1"}


@query("case_days", sql(" UNION ALL ".join(f"SELECT '{n}' AS kind, * FROM (SELECT * FROM ({DAYS}) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY {o}, anchor_pos) = 1)" for n, o in CASES.items()), "masked"))
def _(spark, d):
    y, r = F.col("empty") == 1, F.col("rec")
    m = masked(spark, d).where("delta = 0.1 and model = 'blend'")
    before = F.coalesce(F.lag("empty").over(Window.partitionBy("entity_id", "anchor_pos").orderBy("step")), F.col("empty"))
    days = m.withColumn("_t", F.abs(F.col("empty") - before)).groupBy("entity_id", "anchor_pos").agg(
        F.count_if(r & y).alias("safe"), F.count_if(r & ~y).alias("conflict"), F.count_if(~r & y).alias("missed"), F.sum("_t").alias("transitions"),
    )
    good = ((F.col("safe") > 0) & (F.col("conflict") == 0)).cast("long")
    first = {"success": (good, F.col("safe")), "conflict": (F.col("conflict"), F.lit(0)), "missed": (F.col("missed"), F.lit(0)), "transitions": (F.col("transitions"), F.lit(0))}
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), a.alias("_a"), b.cast("long").alias("_b")) for n, (a, b) in first.items())))
    rows = days.withColumn("_x", kinds).select("*", "_x.*")
    return P.top_one(rows, ["entity_id", "kind"], [F.desc("_a"), F.desc("_b"), F.asc("anchor_pos")]).select("kind", "entity_id", "anchor_pos", "safe", "conflict", "missed", "transitions")


BEST_DAY = "SELECT entity_id, anchor_pos, active_models, union_kwh FROM (SELECT entity_id, anchor_pos, any_value(a) AS active_models, sum(kwh) FILTER (u AND empty = 1) AS union_kwh FROM (SELECT entity_id, anchor_pos, step, any_value(kwh) AS kwh, any_value(empty) AS empty, bool_or(rec) AS u FROM masked WHERE delta = 0.2 GROUP BY 1, 2, 3) JOIN (SELECT entity_id, anchor_pos, count(DISTINCT model) FILTER (rec) AS a FROM masked WHERE delta = 0.2 GROUP BY 1, 2) USING (entity_id, anchor_pos) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY active_models DESC, round(coalesce(union_kwh, 0), 6) DESC, anchor_pos) = 1"


def best_day(m):
    """The day of each entity with the most models that recommend something, then the most safe load of any of them."""
    active = m.groupBy("entity_id", "anchor_pos").agg(F.count_distinct(F.when(F.col("rec"), F.col("model"))).alias("active_models"))
    union = m.groupBy("entity_id", "anchor_pos", "step").agg(F.any_value("kwh").alias("kwh"), F.any_value("empty").alias("empty"), F.bool_or("rec").alias("u"))
    days = union.groupBy("entity_id", "anchor_pos").agg(F.sum(F.when(F.col("u") & (F.col("empty") == 1), F.col("kwh"))).alias("union_kwh")).join(active, ["entity_id", "anchor_pos"])
    return P.top_one(days, ["entity_id"], [F.desc("active_models"), F.desc(F.round(F.coalesce("union_kwh", F.lit(0.0)), 6)), F.asc("anchor_pos")])


@query("same_day_compare", sql(BEST_DAY, "masked"), "union_kwh")
def _(spark, d):
    return best_day(masked(spark, d).where("delta = 0.2"))


@query("same_day_summary", sql(f"SELECT m.entity_id, m.model, anchor_pos, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh, coalesce(any_value(windows), 0)::BIGINT AS recommended_windows, coalesce(any_value(safe_w), 0)::BIGINT AS safe_windows FROM masked m JOIN ({BEST_DAY}) b USING (entity_id, anchor_pos) LEFT JOIN (SELECT entity_id, model, anchor_pos, count(*) AS windows, count(*) FILTER (safe = 1) AS safe_w FROM runs WHERE delta = 0.2 GROUP BY 1, 2, 3) USING (entity_id, model, anchor_pos) WHERE delta = 0.2 GROUP BY 1, 2, 3", "masked", "runs"), "safe_kwh")
def _(spark, d):
    """Policy and windows of each model on that day."""
    m = masked(spark, d).where("delta = 0.2")
    day = m.join(best_day(m).select("entity_id", "anchor_pos"), ["entity_id", "anchor_pos"], "left_semi")
    by = ["entity_id", "model", "anchor_pos"]
    windows = W.window_summary(day, by, by).select(*by, "recommended_windows", "safe_windows")
    rows = M.policy_rows(day, by, ["anchor_pos"]).select(*by, "recommended_intervals", "safe_intervals", "safe_kwh")
    return rows.join(windows, by, "left").fillna(0)


LATE = """late AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER w = 4 THEN min(p) OVER w END AS low FROM (SELECT * FROM long_all WHERE split = 'test' AND hour(anchor_time) = 23 AND minute(anchor_time) = 45) WINDOW w AS (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
late_mask AS MATERIALIZED (SELECT * FROM (SELECT *, max(low) OVER (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS opening FROM late) l JOIN chosen c USING (entity_id, model) WHERE delta = 0.2 AND opening >= c.threshold - 1e-11)
"""


@query("first_qualifying_day", sql("", "masked", "long_all").rstrip() + ",\n" + LATE + "SELECT 'midnight' AS form, entity_id, model, min(anchor_pos) AS anchor_pos FROM (SELECT entity_id, model, anchor_pos, sum(kwh) FILTER (rec AND empty = 1) AS k FROM masked WHERE delta = 0.2 GROUP BY 1, 2, 3) WHERE k > 0 GROUP BY 2, 3 UNION ALL SELECT 'calendar_day', entity_id, model, min(anchor_pos) FROM late_mask GROUP BY 2, 3")
def _(spark, d):
    """The first midnight horizon with safe load, and the first horizon from 23:45, that of a calendar day, with a recommendation."""
    days = masked(spark, d).where("delta = 0.2").groupBy("entity_id", "model", "anchor_pos").agg(F.sum(F.when(F.col("rec") & (F.col("empty") == 1), F.col("kwh"))).alias("k"))
    first = lambda rows, form: rows.groupBy("entity_id", "model").agg(F.min("anchor_pos").alias("anchor_pos")).withColumn("form", F.lit(form))
    late = base.expanded(base.forecasts(spark, d), ("test",), (F.hour("target_time") == 23) & (F.minute("target_time") == 45))
    pick = chosen(spark, d).where("delta = 0.2").select("entity_id", "model", "threshold")
    at = W.opening(base.long(late), HK).join(pick, ["entity_id", "model"]).where(F.col("opening") >= F.col("threshold") - 1e-11)
    return first(days.where("k > 0"), "midnight").unionByName(first(at, "calendar_day"))


def replay(length):
    return f"""SELECT {length} AS min_steps, entity_id, model, thr_idx, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals FROM (
      SELECT *, coalesce(o >= threshold - 1e-11, FALSE) AS rec FROM (SELECT *, max(low) OVER (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS o FROM (
        SELECT *, CASE WHEN count(*) OVER w = {length} THEN min(p) OVER w END AS low FROM long_mid WHERE split = 'test' WINDOW w AS (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING))) JOIN grid ON TRUE) GROUP BY ALL"""


REPLAYED = " UNION ALL ".join(replay(k) for k in (4, 8, 16))
REPORTED = "SELECT 4 AS min_steps, entity_id, model, thr_idx, count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals FROM masked WHERE delta = 0.1 GROUP BY entity_id, model, thr_idx"


@query("grid_reference_replay", sql(f"SELECT r.*, (p.thr_idx IS NOT NULL)::INTEGER AS reported, (r.recommended_intervals = p.recommended_intervals AND r.safe_intervals = p.safe_intervals)::INTEGER AS reconciles FROM ({REPLAYED}) r LEFT JOIN ({REPORTED}) p USING (min_steps, entity_id, model, thr_idx)", "long_mid", "masked"))
def _(spark, d):
    """Every model, threshold and least length on test rows; the selected policies are marked and compared with their own accounting."""
    by = ["min_steps", "entity_id", "model", "thr_idx"]
    rows = W.openings(midnight(spark, d, ("test",)), HK, (4, 8, 16))
    replayed = P.sweep(rows, ["min_steps", "entity_id", "model"], ["anchor_pos"]).select(*by, "recommended_intervals", "safe_intervals")
    own = M.policy_rows(masked(spark, d).where("delta = 0.1"), by[1:], ["anchor_pos"])
    own = own.select(F.lit(4).alias("min_steps"), *by[1:], F.col("recommended_intervals").alias("_r"), F.col("safe_intervals").alias("_s"))
    same = (F.col("recommended_intervals") == F.col("_r")) & (F.col("safe_intervals") == F.col("_s"))
    return replayed.join(own, by, "left").select(*by, "recommended_intervals", "safe_intervals", F.col("_r").isNotNull().cast("int").alias("reported"), same.cast("int").alias("reconciles"))
