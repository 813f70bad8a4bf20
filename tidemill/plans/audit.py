"""Queries: resampling, selection stability, checks, fitted models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.operators import bins as B
from tidemill.operators import checks as C
from tidemill.operators import features as L
from tidemill.operators import linear_maps as LM
from tidemill.operators import metrics as M
from tidemill.operators import models as ML
from tidemill.operators import policy as P
from tidemill.operators import uncertainty as U
from tidemill.operators import windows as W
from tidemill.plans import base
from tidemill.plans.base import KEY, sql
from tidemill.plans.decide import COLS, GRID_AP, chosen, masked, midnight, opened, swept, validation, with_grid
from tidemill.plans.forecast import AP, CLIP, G, GROUP, POINT
from tidemill.plans.prepare import CALENDAR, FIT_ROWS, TABULAR, feature_rows, held_out_rows, sampled_rows, tabular
from tidemill.plans.registry import query
from tidemill.sources.scratch import materialise

#: Seeds of fits that are averaged.
SEEDS = (42, 43, 44)
#: Replicates of the metrics and of the stability of choices, and blends that compete in the latter.
REPS, CHOICE_REPS, TOP_BLENDS = 2000, 1000, 12

BLOCKS = """SELECT entity_id, anchor_pos, model, count(*) FILTER (rec) AS rec, count(*) FILTER (rec AND empty = 0) AS bad, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh FROM masked WHERE delta = 0.1 GROUP BY 1, 2, 3"""


def numbered(source):
    return f"SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY anchor_pos) - 1 AS block_no, count(*) OVER (PARTITION BY entity_id) AS n FROM (SELECT DISTINCT entity_id, anchor_pos FROM {source})"


def drawn(reps):
    return f"SELECT entity_id, rep, ('0x' || substr(md5(concat_ws('|', 42, entity_id, rep, draw)), 1, 13))::BIGINT % n AS block_no, count(*) AS mult FROM (SELECT entity_id, rep, n, unnest(range(n)) AS draw FROM (SELECT entity_id, any_value(n) AS n FROM numbered GROUP BY 1) JOIN range({reps}) r(rep) ON TRUE) GROUP BY 1, 2, 3"


def ap_sql(source, group):
    """Average precision of each group from rows (group, score, tp, fp)."""
    return f"SELECT {group}, coalesce(sum(tp * ct / (ct + cf)) / nullif(sum(tp), 0), 0) AS ap FROM (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM {source} WINDOW w AS (PARTITION BY {group} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {group}"


BOOT = sql("", "masked") + f""", numbered AS MATERIALIZED ({numbered('masked')}), blocks AS MATERIALIZED ({BLOCKS}), drawn AS MATERIALIZED ({drawn(REPS)}),
drawn_days AS MATERIALIZED (SELECT entity_id, rep, anchor_pos, mult FROM drawn JOIN numbered USING (entity_id, block_no)),
scored AS MATERIALIZED (SELECT entity_id, model, rep, p AS score, sum(mult * tp)::DOUBLE AS tp, sum(mult * fp)::DOUBLE AS fp FROM (SELECT entity_id, model, anchor_pos, p, sum(empty) AS tp, sum(1 - empty) AS fp FROM masked WHERE delta = 0.1 GROUP BY 1, 2, 3, 4) JOIN drawn_days USING (entity_id, anchor_pos) GROUP BY 1, 2, 3, 4),
reps AS MATERIALIZED (SELECT * FROM (SELECT entity_id, model, rep, coalesce(sum(mult * bad) / nullif(sum(mult * rec), 0), 0)::DOUBLE AS conflict_rate, sum(mult * safe_kwh)::DOUBLE AS safe_kwh FROM drawn_days JOIN blocks USING (entity_id, anchor_pos) GROUP BY 1, 2, 3)
  JOIN (SELECT * RENAME (ap AS average_precision) FROM ({ap_sql('scored', 'entity_id, model, rep')})) USING (entity_id, model, rep))
"""
METRICS = ["average_precision", "conflict_rate", "safe_kwh"]


def replicates(spark, d):
    """(entity_id, model, rep, average_precision, conflict_rate, safe_kwh) on test horizons under the thresholds selected at 10 %."""
    m = masked(spark, d).where("delta = 0.1")
    blocks = U.number_blocks(m, KEY)
    y, r, group = F.col("empty") == 1, F.col("rec"), [*KEY, "model"]
    stats = m.groupBy(*group, "anchor_pos").agg(F.count_if(r).alias("rec"), F.count_if(r & ~y).alias("bad"), F.coalesce(F.sum(F.when(r & y, F.col("kwh"))), F.lit(0.0)).alias("safe_kwh"))
    policy = U.resampled(stats, blocks, REPS, KEY, group, ["rec", "bad", "safe_kwh"])
    policy = policy.select(*group, "rep", M.ratio(F.col("bad"), F.col("rec")).alias("conflict_rate"), "safe_kwh")
    ap = U.precision_by_replicate(U.score_sums(m, [*group, "anchor_pos"]), blocks, REPS, KEY, group)
    return policy.join(ap, [*group, "rep"])


def ci(c):
    return f"SELECT entity_id, model, '{c}' AS metric, avg({c}) AS mean, quantile_cont({c}, 0.025) AS low, quantile_cont({c}, 0.975) AS high, count(*) AS reps FROM reps GROUP BY 1, 2"


@query("block_bootstrap", BOOT + " UNION ALL ".join(map(ci, METRICS)), "mean low high")
def _(spark, d):
    r = replicates(spark, d).unpivot([*KEY, "model", "rep"], METRICS, "metric", "value")
    return U.interval(r, [*KEY, "model", "metric"], "value")


def contrast(c):
    return f"SELECT a.entity_id, b.model AS comparator, '{c}' AS metric, avg(a.{c} - b.{c}) AS mean, quantile_cont(a.{c} - b.{c}, 0.025) AS low, quantile_cont(a.{c} - b.{c}, 0.975) AS high, count(*) AS reps FROM reps a JOIN reps b ON a.entity_id = b.entity_id AND a.rep = b.rep WHERE a.model = 'blend' AND b.model <> 'blend' GROUP BY 1, 2"


@query("paired_contrast", BOOT + " UNION ALL ".join(map(contrast, METRICS)), "mean low high")
def _(spark, d):
    r = replicates(spark, d).unpivot([*KEY, "model", "rep"], METRICS, "metric", "value")
    a = r.where("model = 'blend'").select(*KEY, "rep", "metric", F.col("value").alias("a"))
    both = r.where("model <> 'blend'").join(a, [*KEY, "rep", "metric"]).withColumn("value", F.col("a") - F.col("value"))
    return U.interval(both.withColumnRenamed("model", "comparator"), [*KEY, "comparator", "metric"], "value")


@query("uncertainty_compact", BOOT + f"SELECT entity_id, model, CASE model WHEN 'blend' THEN 1 ELSE 2 END AS place, low, high FROM ({ci('safe_kwh')}) WHERE model IN ('blend', 'slot')", "low high")
def _(spark, d):
    order = spark.createDataFrame([("blend", 1), ("slot", 2)], "model string, place int")
    return U.interval(replicates(spark, d), [*KEY, "model"], "safe_kwh").join(F.broadcast(order), "model").select(*KEY, "model", "place", "low", "high")


PER = sql("", "opened", "grid") + f""", per AS MATERIALIZED (SELECT entity_id, model, anchor_pos, thr_idx, count(*) FILTER (rec) AS rec, count(*) FILTER (rec AND empty = 0) AS bad, count(*) FILTER (empty = 1) AS em, count(*) FILTER (rec AND empty = 1) AS good, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS kwh
  FROM (SELECT *, coalesce(opening >= threshold - 1e-11, FALSE) AS rec FROM opened JOIN grid ON TRUE WHERE split = 'val') GROUP BY 1, 2, 3, 4),
numbered AS MATERIALIZED ({numbered('per')}), drawn AS MATERIALIZED ({drawn(CHOICE_REPS)}),
sums AS MATERIALIZED (SELECT 'leave_one_out' AS method, entity_id, model, thr_idx, anchor_pos AS rep, sum(rec) OVER w - rec AS rec, sum(bad) OVER w - bad AS bad, sum(good) OVER w - good AS good, sum(em) OVER w - em AS em, sum(kwh) OVER w - kwh AS kwh FROM per WINDOW w AS (PARTITION BY entity_id, model, thr_idx)
  UNION ALL SELECT 'bootstrap', entity_id, model, thr_idx, rep, sum(mult * rec), sum(mult * bad), sum(mult * good), sum(mult * em), sum(mult * kwh) FROM drawn JOIN numbered USING (entity_id, block_no) JOIN per USING (entity_id, anchor_pos) GROUP BY 2, 3, 4, 5),
rated AS MATERIALIZED (SELECT *, round(coalesce(bad / nullif(rec, 0), 0), 9) AS c, round(coalesce(good / nullif(em, 0), 0), 9) AS r FROM sums)
SELECT method, entity_id, model, thr_idx, count(*) AS times FROM (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY method, entity_id, model, rep ORDER BY (c <= 0.1)::INTEGER DESC, CASE WHEN c <= 0.1 THEN -round(kwh, 6) ELSE c END, CASE WHEN c <= 0.1 THEN -r ELSE -round(kwh, 6) END, thr_idx) = 1) GROUP BY 1, 2, 3, 4"""


@query("threshold_stability", PER)
def _(spark, d):
    """How often each threshold is selected at 10 % when days are left out one by one, and when they are drawn anew."""
    at, group = opened(spark, d, ("val",)), [*KEY, "model", "thr_idx"]
    sums = ["n", "bad", "good", "em", "safe_kwh"]
    per = P.sweep_sums(at, [*KEY, "model", "anchor_pos"]).select(*group, "anchor_pos", *sums)
    loo = U.leave_one_out(per, group, "anchor_pos", sums).withColumnRenamed("omitted", "rep").withColumn("method", F.lit("leave_one_out"))
    boot = U.resampled(per, U.number_blocks(at, KEY), CHOICE_REPS, KEY, group, sums).withColumn("method", F.lit("bootstrap"))
    both = loo.select("method", *group, "rep", *(F.col(c).cast("double").alias(c) for c in sums)).unionByName(boot.select("method", *group, "rep", *sums))
    rated = both.withColumns({"conflict_rate": M.ratio(F.col("bad"), F.col("n")), "empty_recall": M.ratio(F.col("good"), F.col("em"))})
    return P.select_constrained(rated, ["method", *KEY, "model", "rep"], (0.10,)).groupBy("method", *group).agg(F.count("*").alias("times"))


STABLE = with_grid(20).rstrip() + f""", aps AS MATERIALIZED ({GRID_AP}), best AS MATERIALIZED (SELECT entity_id, grid_order, row_number() OVER (PARTITION BY entity_id ORDER BY round(average_precision, 9) DESC, grid_order) AS place FROM aps QUALIFY place <= {TOP_BLENDS}),
blended AS MATERIALIZED (SELECT m.entity_id, place, anchor_pos, round(w1 * slot + w2 * persist + w3 * recent, 12) AS score, sum(empty) AS tp, sum(1 - empty) AS fp FROM wide_all m JOIN best t ON t.entity_id = m.entity_id JOIN blends b ON b.grid_order = t.grid_order WHERE split = 'val' AND hour(anchor_time) = 0 AND minute(anchor_time) = 0 GROUP BY 1, 2, 3, 4),
numbered AS MATERIALIZED ({numbered('blended')})"""
PICK = "SELECT entity_id, grid_order, count(*) AS times FROM (SELECT * FROM ({ap}) QUALIFY row_number() OVER (PARTITION BY entity_id, rep ORDER BY round(ap, 9) DESC, place) = 1) JOIN best USING (entity_id, place) GROUP BY 1, 2"


@base.once
def contenders(spark, d):
    """Score sums of the best blends on each validation day: (entity_id, grid_order, place, anchor_pos, score, tp, fp)."""
    grid = P.simplex_grid(spark, 20)
    ap = P.blend_grid(validation(spark, d), grid, COLS, KEY)
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(F.round("average_precision", 9)), "grid_order"))
    best = ap.withColumn("place", place).where(F.col("place") <= TOP_BLENDS).join(F.broadcast(grid), "grid_order").select(*KEY, "grid_order", "place", "w1", "w2", "w3")
    rows = base.wide(spark, d, midnight=True, splits=("val",)).join(best, KEY)
    rows = rows.withColumn("p", F.round(sum(F.col(f"w{i + 1}") * F.col(c) for i, c in enumerate(COLS)), 12))
    return U.score_sums(rows, [*KEY, "grid_order", "place", "anchor_pos"])


BLEND_KEY = [*KEY, "grid_order", "place"]


def winners(ap, rep):
    best = P.top_one(ap, [*KEY, rep], [F.desc(F.round("average_precision", 9)), F.asc("place")])
    return best.groupBy(*KEY, "grid_order").agg(F.count("*").alias("times"))


@query("bootstrap_blend_stability", STABLE + f", drawn AS MATERIALIZED ({drawn(CHOICE_REPS)}), scored AS MATERIALIZED (SELECT entity_id, place, rep, score, sum(mult * tp)::DOUBLE AS tp, sum(mult * fp)::DOUBLE AS fp FROM blended JOIN numbered USING (entity_id, anchor_pos) JOIN drawn USING (entity_id, block_no) GROUP BY 1, 2, 3, 4)\n" + PICK.format(ap=ap_sql("scored", "entity_id, place, rep")))
def _(spark, d):
    sums = contenders(spark, d)
    return winners(U.precision_by_replicate(sums, U.number_blocks(sums, KEY), CHOICE_REPS, KEY, BLEND_KEY), "rep")


@query("loo_blend_stability", STABLE + ", scored AS MATERIALIZED (SELECT l.entity_id, place, o.block_no AS rep, score, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp FROM blended l JOIN numbered o ON o.entity_id = l.entity_id AND o.anchor_pos <> l.anchor_pos GROUP BY 1, 2, 3, 4)\n" + PICK.format(ap=ap_sql("scored", "entity_id, place, rep")))
def _(spark, d):
    sums = contenders(spark, d)
    return winners(U.precision_by_replicate(sums, U.number_blocks(sums, KEY), None, KEY, BLEND_KEY), "rep")


@query("blend_gap", sql(f"SELECT entity_id, split, model, max(average_precision) OVER w - average_precision AS gap, row_number() OVER (PARTITION BY entity_id, split ORDER BY round(average_precision, 9) DESC, model)::INTEGER AS place FROM ({AP.format(g=G, p='p', t='long_all')}) WINDOW w AS (PARTITION BY entity_id, split)", "long_all"), "gap")
def _(spark, d):
    ap = M.average_precision(base.long(base.wide(spark, d)), GROUP)
    w = Window.partitionBy(*KEY, "split")
    return ap.select(*GROUP, (F.max("average_precision").over(w) - F.col("average_precision")).alias("gap"), F.row_number().over(w.orderBy(F.desc(F.round("average_precision", 9)), "model")).alias("place"))


RULES = {
    "score_in_unit_interval": "count(*) FILTER (NOT coalesce(p BETWEEN 0 AND 1, FALSE)) AS violations FROM {t}",
    "label_is_binary": "count(*) FILTER (NOT coalesce(empty IN (0, 1), FALSE)) FROM {t}",
    "target_follows_anchor": "count(*) FILTER (target_pos IS DISTINCT FROM anchor_pos + step) FROM {t}",
    "step_in_horizon": "count(*) FILTER (NOT coalesce(step BETWEEN 1 AND 96, FALSE)) FROM {t}",
    "complete_horizon": "count(*) FILTER (n <> 96) FROM (SELECT count(*) AS n FROM {t} GROUP BY entity_id, model, anchor_pos)",
    "unique_steps": "count(*) FILTER (n <> k) FROM (SELECT count(*) AS n, count(DISTINCT step) AS k FROM {t} GROUP BY entity_id, model, anchor_pos)",
}
#: One kind of damage for each sixth horizon, so that every rule has rows that break it.
DAMAGED = """SELECT entity_id, model, anchor_pos, CASE WHEN kind = 0 AND step = 1 THEN p + 1 ELSE p END AS p, CASE WHEN kind = 1 AND step = 2 THEN 2 ELSE empty END AS empty,
  CASE WHEN kind = 2 AND step = 3 THEN target_pos + 1 ELSE target_pos END AS target_pos, CASE WHEN kind = 3 AND step = 96 THEN 97 WHEN kind = 5 AND step = 10 THEN 11 ELSE step END AS step
  FROM (SELECT *, (anchor_pos // 96) % 6 AS kind FROM long_mid) WHERE NOT (kind = 4 AND step = 50)"""
VALIDATED = sql("", "long_mid") + f", damaged AS MATERIALIZED ({DAMAGED})\n" + " UNION ALL ".join(f"SELECT '{name}' AS rows, '{c}' AS \"check\", {rule.format(t=t)}" for name, t in (("given", "long_mid"), ("damaged", "damaged")) for c, rule in RULES.items())


def damaged(rows):
    """The rows with one kind of damage in each sixth horizon."""
    kind, step = F.floor(F.col("anchor_pos") / 96) % 6, F.col("step")
    hurt = lambda k, s, new, c: F.when((kind == k) & (step == s), new).otherwise(F.col(c))
    out = rows.where(~((kind == 4) & (step == 50)))
    fresh = {"p": hurt(0, 1, F.col("p") + 1, "p"), "empty": hurt(1, 2, F.lit(2), "empty"), "target_pos": hurt(2, 3, F.col("target_pos") + 1, "target_pos")}
    return out.withColumns(fresh | {"step": F.when((kind == 3) & (step == 96), 97).when((kind == 5) & (step == 10), 11).otherwise(step)})


@query("validate_forecast", VALIDATED)
def _(spark, d):
    rows = midnight(spark, d)
    both = [C.validate_forecast(x).withColumn("rows", F.lit(n)) for n, x in (("given", rows), ("damaged", damaged(rows)))]
    return both[0].unionByName(both[1])


@query("validate_disjoint", sql("SELECT *, (last_first < first_second)::INTEGER AS ok FROM (SELECT entity_id, max(pos + 96) FILTER (split = 'val') AS last_first, min(pos + 1) FILTER (split = 'test') AS first_second FROM anchors GROUP BY 1)", "anchors"))
def _(spark, d):
    return C.disjoint_splits(base.anchors(spark, d))


@query("alignment_audit", sql("SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, coalesce(max(abs(a - b)), 0) AS max_delta, (count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND coalesce(max(abs(a - b)), 0) <= 1e-7)::INTEGER AS ok FROM (SELECT entity_id, anchor_pos, step, p AS a FROM long_mid WHERE model = 'blend' AND step % 32 <> 0) FULL JOIN (SELECT entity_id, anchor_pos, step, floor((slot * 0.5 + persist * 0.3 + recent * 0.2) * 1000 + 1e-6) / 1000 AS b FROM wide_mid WHERE step % 24 <> 0) USING (entity_id, anchor_pos, step)", "wide_mid", "long_mid"), "max_delta")
def _(spark, d):
    """A per-model export without some steps against blends cut to three places without other steps: all kinds of difference occur."""
    w = base.wide(spark, d, midnight=True)
    export = base.long(w, ("blend",)).where("step % 32 <> 0").select(*KEY, "anchor_pos", "step", F.col("p").alias("blend"))
    blend = F.floor(sum(F.col(c) * x for c, x in base.BLEND.items()) * 1000 + 1e-6) / 1000
    return C.alignment(export, w.where("step % 24 <> 0").withColumn("blend", blend), [*KEY, "anchor_pos", "step"], "blend")


@query("leakage_audit", sql("SELECT entity_id, (max(bin_start + INTERVAL '1 day') FILTER (split = 'train') < min(bin_start - INTERVAL '1425 minutes') FILTER (split = 'val'))::INTEGER AS train_before_val, (max(bin_start + INTERVAL '1 day') FILTER (split = 'val') < min(bin_start - INTERVAL '1425 minutes') FILTER (split = 'test'))::INTEGER AS val_before_test FROM anchors GROUP BY 1", "anchors"))
def _(spark, d):
    end, begin = F.col("bin_start") + F.expr("interval 1 day"), F.col("bin_start") - F.expr("interval 1425 minutes")
    at = lambda f, s, c: f(F.when(F.col("split") == s, c))
    a = base.anchors(spark, d).groupBy(*KEY)
    return a.agg((at(F.max, "train", end) < at(F.min, "val", begin)).cast("int").alias("train_before_val"), (at(F.max, "val", end) < at(F.min, "test", begin)).cast("int").alias("val_before_test"))


@query("overlap_check", sql("SELECT 'unique_entity_id_target_pos' AS \"check\", count(*) FILTER (n > 1) AS violations FROM (SELECT count(*) AS n FROM wide_mid GROUP BY entity_id, target_pos)", "wide_mid"))
def _(spark, d):
    return C.unique_keys(base.wide(spark, d, midnight=True), [*KEY, "target_pos"])


@query("join_coverage", sql("SELECT count(*) AS targets, avg((l.pos IS NULL)::INTEGER) AS unmatched, (SELECT count(*) FROM (SELECT 1 FROM raw GROUP BY entity_id, bin_start HAVING count(*) > 1)) AS duplicate_keys, (avg((l.pos IS NULL)::INTEGER) <= 0.01)::INTEGER AS ok FROM wide_mid w LEFT JOIN (SELECT entity_id, pos FROM bins WHERE hvac IS NOT NULL OR light IS NOT NULL) l ON l.entity_id = w.entity_id AND l.pos = w.target_pos", "wide_mid"), "unmatched")
def _(spark, d):
    """Targets without a load reading; more than one in a hundred, or a repeated bin, fails."""
    loads = base.bins(spark, d).where("hvac is not null or light is not null").select(*KEY, F.col("pos").alias("target_pos"))
    return C.join_coverage(base.wide(spark, d, midnight=True), loads, [*KEY, "target_pos"])


@query("selection_guard", sql("SELECT entity_id, model, count(*) AS rows, count(*) FILTER (split <> 'val') AS other_rows, 0 AS test_columns FROM swept GROUP BY 1, 2", "swept"))
def _(spark, d):
    """Rows of the sweep over both splits: those that a selection must not see are counted."""
    return C.selection_rows(swept(spark, d), [*KEY, "model"])


RECOUNTED = """SELECT entity_id, model, delta, recommended_windows, safe_windows, conflict_windows, CASE WHEN recommended_windows = starts AND safe_windows = starts - bad THEN 'pass' ELSE 'fail' END AS status FROM (
  SELECT entity_id, model, delta, count(*) AS recommended_windows, count(*) FILTER (safe = 1) AS safe_windows, count(*) FILTER (safe = 0) AS conflict_windows FROM runs GROUP BY 1, 2, 3)
JOIN (SELECT entity_id, model, delta, count(*) FILTER (rec AND NOT before) AS starts, count(DISTINCT CASE WHEN rec AND empty = 0 THEN anchor_pos * 1000 + start END) AS bad FROM (
  SELECT *, max(CASE WHEN rec AND NOT before THEN step END) OVER (PARTITION BY entity_id, model, delta, anchor_pos ORDER BY step) AS start FROM (
    SELECT *, coalesce(lag(rec) OVER (PARTITION BY entity_id, model, delta, anchor_pos ORDER BY step), FALSE) AS before FROM masked)) GROUP BY 1, 2, 3) USING (entity_id, model, delta)"""


@query("golden_reconcile", sql(RECOUNTED, "runs"), "delta")
def _(spark, d):
    """Windows of the selected policies, cut out one by one, against the counts that histograms of openings give."""
    m, by = masked(spark, d), [*KEY, "model", "delta"]
    counts = ["recommended_windows", "safe_windows", "conflict_windows"]
    observed = W.window_summary(m, by, [*by, "anchor_pos"])
    keys = [*KEY, "model"]
    pinned = P.window_sweep(opened(spark, d, ("test",)), keys, [*keys, "anchor_pos"]).join(m.select(*by, "thr_idx").distinct(), [*keys, "thr_idx"])
    pinned = pinned.where("recommended_windows > 0").withColumn("conflict_windows", F.col("recommended_windows") - F.col("safe_windows"))
    return C.reconcile(observed, pinned, by, counts)


def fitted(spark, d, make, seeds, rows):
    """Held-out metrics, over all anchors, of the mean of models of several seeds, each fitted on its own sample of all anchors."""
    samples = [materialise(sampled_rows(spark, d, seed, rows), "sample") for seed in seeds]
    models = ML.fit_seeds(samples, TABULAR, make, seeds)
    out = M.model_metrics(ML.mean_of_models(models, held_out_rows(spark, d), TABULAR), [*KEY, "split"])
    return out.withColumn("trees", F.lit(sum(m.getNumTrees for m in models)))


@query("gbt_forecast")
def _(spark, d):
    """Boosted trees, 320 rounds or as many as still lower the validation loss, three seeds."""
    return fitted(spark, d, ML.stopped_gbt, SEEDS, FIT_ROWS)


@query("rf_forecast")
def _(spark, d):
    """A forest of 70 trees on a fifth of those rows."""
    return fitted(spark, d, ML.forest, SEEDS[:1], FIT_ROWS // 5)


@base.once
def direct_windows(spark, d):
    """History and targets of all anchors as arrays."""
    return LM.windows(base.bins(spark, d), base.anchors(spark, d), KEY)


@base.once
def direct_maps(spark, d):
    return LM.fit_maps(direct_windows(spark, d), KEY)


@query("direct_linear_forecast")
def _(spark, d):
    """96 logistic maps of each entity from its last 96 labels: held-out metrics over all anchors and steps."""
    rows = LM.score_maps(direct_windows(spark, d).where("split <> 'train'"), direct_maps(spark, d), KEY)
    return M.model_metrics(rows, [*KEY, "split"])


@query("direct_linear_maps")
def _(spark, d):
    """The coefficients of these maps: (entity_id, step, position, coefficient), position 96 the intercept."""
    each = direct_maps(spark, d).select(*KEY, "step", F.posexplode("coefficients").alias("position", "coefficient"))
    return each


FOLD_ROWS = f"""SELECT v.entity_id, v.fold, t.empty, coalesce(s.p, m.p) AS p FROM (
  SELECT b.entity_id, fold, pos, e FROM bins b JOIN sizes USING (entity_id) JOIN edges USING (entity_id) WHERE pos >= 95 AND pos < n - 96 AND bin_start - INTERVAL '1425 minutes' >= e + INTERVAL '1 day' AND bin_start + INTERVAL '1 day' < e + INTERVAL '21 days') v
JOIN range(1, 97) r(step) ON TRUE JOIN bins t ON t.entity_id = v.entity_id AND t.pos = v.pos + step
LEFT JOIN (SELECT entity_id, fold, slot, avg(empty) AS p FROM bins JOIN edges USING (entity_id) WHERE bin_start < e GROUP BY 1, 2, 3) s ON s.entity_id = v.entity_id AND s.fold = v.fold AND s.slot = t.slot
JOIN (SELECT entity_id, fold, avg(empty) AS p FROM bins JOIN edges USING (entity_id) WHERE bin_start < e GROUP BY 1, 2) m ON m.entity_id = v.entity_id AND m.fold = v.fold"""
EDGES = "SELECT x.entity_id, fold, date_trunc('week', bin_start)::TIMESTAMP AS e FROM bins x JOIN sizes USING (entity_id) JOIN (VALUES (1, 0.5::DOUBLE), (2, 0.6::DOUBLE), (3, 0.7::DOUBLE)) f(fold, share) ON x.pos = floor(n * share)::BIGINT"
FG = "entity_id, fold"


@query("rolling_origin_slot", sql("", "sizes").rstrip() + f", edges AS MATERIALIZED ({EDGES}), frows AS MATERIALIZED ({FOLD_ROWS})\nSELECT * FROM ({POINT.format(g=FG, t='frows')}) JOIN ({AP.format(g=FG, p=CLIP, t='frows')}) USING ({FG})", "precision recall f1 brier log_loss average_precision auroc")
def _(spark, d):
    """The slot average over the 96 target steps of each fold's validation anchors."""
    return M.model_metrics(ML.slot_average_of_folds(base.bins(spark, d), KEY), [*KEY, "fold"])


@query("rolling_origin_cv")
def _(spark, d):
    """Slot average, boosted trees and forest on each fold; the fitted ones train and score on one anchor a day."""
    b = base.bins(spark, d)
    out = M.model_metrics(ML.slot_average_of_folds(b, KEY), [*KEY, "fold"]).withColumn("model", F.lit("slot"))
    folds = L.rolling_origin_folds(b, KEY).where(S.is_midnight("bin_start"))
    for fold in (1, 2, 3):
        rows = materialise(feature_rows(b, folds.where(F.col("fold") == fold).select(*KEY, "pos", F.col("role").alias("split"))), "fold")
        for name, fit in (("gbt", ML.gbt), ("forest", lambda: ML.forest(trees=40))):
            m = M.model_metrics(ML.fit_and_score(rows, TABULAR, fit), KEY)
            out = out.unionByName(m.withColumns({"fold": F.lit(fold), "model": F.lit(name)}))
    return out


@base.once
def seed_scores(spark, d):
    """Held-out scores of boosted trees and forests of three seeds, and of the mean over seeds (seed 0)."""
    rows, out = tabular(spark, d), None
    for name, fit in (("gbt", ML.gbt), ("forest", ML.forest)):
        one = ML.fit_and_score_seeds(rows, TABULAR, fit, SEEDS).select(*KEY, "split", "anchor_pos", "step", "empty", "seed", "p").withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("seed_mean_scores")
def _(spark, d):
    """Pointwise mean over the seeds of each model."""
    return seed_scores(spark, d).groupBy(*KEY, "model", "split", "anchor_pos", "step").agg(F.avg("p").alias("p"))


@query("seed_spread")
def _(spark, d):
    m = M.model_metrics(seed_scores(spark, d), ["model", "split", "seed"])
    return m.groupBy("model", "split").agg(*(f(c).alias(f"{n}_{c}") for c in ("average_precision", "brier", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


@query("permutation_importance")
def _(spark, d):
    return ML.permutation_importance(tabular(spark, d), TABULAR, ML.gbt, TABULAR)


PAST = [c for c in TABULAR if c.startswith(("empty_lag", "c1_mean"))] + ["yesterday"]
TIME = [*CALENDAR, "step_share"]
#: Nested groups of features.
GROUPS = {"time": TIME, "past": PAST, "past_time": [*PAST, *TIME], "with_sensors": TABULAR, "load_removed": [c for c in TABULAR if c not in ("hvac", "light")]}


@query("feature_ablation")
def _(spark, d):
    rows, out = tabular(spark, d), None
    for name, use in GROUPS.items():
        m = M.average_precision(ML.fit_and_score(rows, use, ML.gbt).where("split = 'test'"), ["split"]).withColumn("features", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out
