"""Queries: scores, blends, forecast metrics and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.operators import bins as B
from tidemill.operators import metrics as M
from tidemill.operators import models as ML
from tidemill.operators import policy as P
from tidemill.plans import base
from tidemill.plans.base import BLEND, KEY, sql
from tidemill.plans.registry import query
from tidemill.sources.scratch import materialise

GROUP = ["entity_id", "split", "model"]


@query("slot_average", sql("SELECT entity_id, target_pos, slot AS p FROM target", "target"), "p")
def _(spark, d):
    b, a = base.bins(spark, d), base.anchors(spark, d)
    return base.components(b, a)[0].select(*KEY, "target_pos", F.col("slot").alias("p"))


@query("convex_blend", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, greatest(1e-6, least(1 - 1e-6, 0.25 * slot + 0.6 * persist + 0.15 * recent)) AS p FROM wide_mid", "wide_mid"), "p")
def _(spark, d):
    """From long scores and a table of weights; a step that lacks a score would stop the query."""
    weights = {"slot": 0.25, "persist": 0.6, "recent": 0.15}
    S.convex_blend(weights)  # refuses negative weights and other sums than one
    rows = base.long(base.wide(spark, d, midnight=True), base.MODELS)
    blend = P.blend_long(rows, spark.createDataFrame(list(weights.items()), "model string, weight double"), [*KEY, "anchor_pos", "step"], len(weights))
    return blend.withColumn("p", S.clip_score("p"))


@query("weights_long", sql("SELECT entity_id, component, weight, 'blend' AS score, sum(weight * p) AS contribution, sum(weight * p) / sum(sum(weight * p)) OVER (PARTITION BY entity_id) AS share FROM (VALUES ('slot', 0.5::DOUBLE), ('persist', 0.3::DOUBLE), ('recent', 0.2::DOUBLE)) t(component, weight) JOIN long_mid ON model = component GROUP BY 1, 2, 3", "long_mid"), "weight contribution share")
def _(spark, d):
    """The blend's weights as rows, with what each component adds to the scores of an entity."""
    weights = spark.createDataFrame(list(BLEND.items()), "model string, weight double")
    rows = base.long(base.wide(spark, d, midnight=True), base.MODELS).join(F.broadcast(weights), "model")
    sums = rows.groupBy(*KEY, F.col("model").alias("component"), "weight").agg(F.sum(F.col("weight") * F.col("p")).alias("contribution"))
    share = F.col("contribution") / F.sum("contribution").over(Window.partitionBy(*KEY))
    return sums.select(*KEY, "component", "weight", F.lit("blend").alias("score"), "contribution", share.alias("share"))


PROFILE = "SELECT entity_id, dow, " + ", ".join(f"avg(occupied) FILTER (h = {h}) AS h{h}" for h in range(24)) + " FROM (SELECT entity_id, (isodow(bin_start) - 1)::INTEGER AS dow, hour(bin_start) AS h, occupied FROM bins) GROUP BY 1, 2"


@query("dow_hour_profile", sql(PROFILE, "bins"), " ".join(f"h{h}" for h in range(24)))
def _(spark, d):
    b = base.bins(spark, d).select(*KEY, F.weekday("bin_start").alias("dow"), F.concat(F.lit("h"), F.hour("bin_start")).alias("h"), "occupied")
    return b.groupBy(*KEY, "dow").pivot("h", [f"h{h}" for h in range(24)]).agg(F.avg("occupied"))


@query("tz_peak_audit", sql("SELECT clock, hour, mean FROM (SELECT 'raw' AS clock, hour(bin_start)::INTEGER AS hour, avg(kwh) AS mean FROM bins WHERE bin_start >= TIMESTAMP '2024-01-05' AND bin_start < TIMESTAMP '2024-01-25' GROUP BY 2 UNION ALL SELECT 'local', hour(bin_start - INTERVAL '8 hours')::INTEGER, avg(kwh) FROM bins WHERE bin_start >= TIMESTAMP '2024-01-05' AND bin_start < TIMESTAMP '2024-01-25' GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY clock ORDER BY round(mean, 9) DESC, hour) = 1", "bins"), "mean")
def _(spark, d):
    b = base.bins(spark, d).where("bin_start >= timestamp_ntz'2024-01-05' and bin_start < timestamp_ntz'2024-01-25'")
    local = F.from_utc_timestamp(F.col("bin_start").cast("timestamp"), "America/Los_Angeles")
    both = b.select(F.explode(F.array(F.struct(F.lit("raw").alias("clock"), F.hour("bin_start").alias("hour")), F.struct(F.lit("local").alias("clock"), F.hour(local).alias("hour")))).alias("x"), "kwh")
    means = both.groupBy("x.clock", "x.hour").agg(F.avg("kwh").alias("mean"))
    return P.top_one(means, ["clock"], [F.desc(F.round("mean", 9)), F.asc("hour")])


@query("data_summary", sql("SELECT entity_id, count(*) AS rows, min(bin_start) AS first_bin, max(bin_start) AS last_bin, avg(occupied) AS occupied_rate, avg(c1) AS mean_count, max(c1) AS max_count FROM bins GROUP BY 1", "bins"), "occupied_rate mean_count")
def _(spark, d):
    return base.bins(spark, d).groupBy(*KEY).agg(F.count("*").alias("rows"), F.min("bin_start").alias("first_bin"), F.max("bin_start").alias("last_bin"), F.avg("occupied").alias("occupied_rate"), F.avg("c1").alias("mean_count"), F.max("c1").alias("max_count"))


AP = """SELECT {g}, coalesce(sum(tp * ct / (ct + cf)) / nullif(sum(tp), 0), 0) AS average_precision, CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(fp * (ct - tp / 2)) / (sum(tp) * sum(fp)) END AS auroc
FROM (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM (SELECT {g}, {p} AS s, sum(empty)::DOUBLE AS tp, sum(1 - empty)::DOUBLE AS fp FROM {t} GROUP BY {g}, s) WINDOW w AS (PARTITION BY {g} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {g}"""
CLIP = "greatest(1e-6, least(1 - 1e-6, p))"
POINT = f"""SELECT {{g}}, count(*) AS n, coalesce(count(*) FILTER (p >= 0.5 AND empty = 1) / nullif(count(*) FILTER (p >= 0.5), 0), 0) AS precision,
  coalesce(count(*) FILTER (p >= 0.5 AND empty = 1) / nullif(sum(empty), 0), 0) AS recall, coalesce(2 * count(*) FILTER (p >= 0.5 AND empty = 1) / nullif(count(*) FILTER (p >= 0.5) + sum(empty), 0), 0) AS f1,
  avg(({CLIP} - empty) ** 2) AS brier, CASE WHEN sum(empty) BETWEEN 1 AND count(*) - 1 THEN avg(-(empty * ln({CLIP}) + (1 - empty) * ln(1 - {CLIP}))) END AS log_loss FROM {{t}} GROUP BY {{g}}"""
G = "entity_id, split, model"


@query("average_precision", sql(f"SELECT * EXCLUDE (auroc) FROM ({AP.format(g=G, p='p', t='long_all')})", "long_all"), "average_precision")
def _(spark, d):
    return M.average_precision(base.long(base.wide(spark, d)), GROUP)


@query("auroc", sql(f"SELECT * EXCLUDE (average_precision) FROM ({AP.format(g=G, p='p', t='long_all')})", "long_all"), "auroc")
def _(spark, d):
    return M.auroc(base.long(base.wide(spark, d)), GROUP)


METRICS = "precision recall f1 brier log_loss"


@query("metrics_by_split", sql(f"SELECT * FROM ({POINT.format(g=G, t='long_all')}) JOIN ({AP.format(g=G, p=CLIP, t='long_all')}) USING ({G})", "long_all"), METRICS + " average_precision auroc")
def _(spark, d):
    return M.model_metrics(base.long(base.wide(spark, d)), GROUP)


@query("threshold_metrics", sql(POINT.format(g="entity_id, model", t="long_all"), "long_all"), METRICS)
def _(spark, d):
    return M.threshold_metrics(base.long(base.wide(spark, d)), [*KEY, "model"])


BUCKETED = "(SELECT *, ((step - 1) // 24)::INTEGER AS bucket FROM long_all)"
BG = "entity_id, split, model, bucket"


@query("horizon_buckets", sql(f"SELECT * FROM ({POINT.format(g=BG, t=BUCKETED)}) JOIN ({AP.format(g=BG, p=CLIP, t=BUCKETED)}) USING ({BG})", "long_all"), METRICS + " average_precision auroc")
def _(spark, d):
    rows = base.long(base.wide(spark, d)).withColumn("bucket", F.floor((F.col("step") - 1) / 24).cast("int"))
    return M.model_metrics(rows, [*GROUP, "bucket"])


CURVE = """SELECT {g}, score, ct / (ct + cf) AS precision, coalesce(ct / nullif(sum(tp) OVER (PARTITION BY {g}), 0), 0) AS recall, coalesce(cf / nullif(sum(fp) OVER (PARTITION BY {g}), 0), 0) AS fpr
FROM (SELECT *, sum(tp) OVER w AS ct, sum(fp) OVER w AS cf FROM (SELECT {g}, p AS score, sum(empty)::DOUBLE AS tp, sum(1 - empty)::DOUBLE AS fp FROM long_all GROUP BY {g}, p) WINDOW w AS (PARTITION BY {g} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def curve(spark, d):
    c = M.score_curve(base.long(base.wide(spark, d)), GROUP)
    w = Window.partitionBy(*GROUP)
    return c.select(*GROUP, "score", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"), M.ratio(F.col("cum_tp"), F.sum("tp").over(w)).alias("recall"), M.ratio(F.col("cum_fp"), F.sum("fp").over(w)).alias("fpr"))


@query("pr_curve", sql(f"SELECT {G}, score, precision, recall FROM ({CURVE.format(g=G)})", "long_all"), "score precision recall")
def _(spark, d):
    return curve(spark, d).drop("fpr")


@query("roc_curve", sql(f"SELECT {G}, score, fpr, recall AS tpr FROM ({CURVE.format(g=G)})", "long_all"), "score fpr tpr")
def _(spark, d):
    return curve(spark, d).select(*GROUP, "score", "fpr", F.col("recall").alias("tpr"))


RANKED = f"SELECT {G}, bin, avg(p) AS mean_p, avg(empty) AS observed, count(*) AS n, abs(avg(p) - avg(empty)) AS gap FROM (SELECT *, greatest(ceil((row_number() OVER (PARTITION BY {G} ORDER BY p, anchor_pos, step) - 1) * 10 / greatest(count(*) OVER (PARTITION BY {G}) - 1, 1)) - 1, 0)::INTEGER AS bin FROM long_all) GROUP BY {G}, bin"


@query("calibration_rank10", sql(RANKED, "long_all"), "mean_p observed gap")
def _(spark, d):
    return M.rank_bins(base.long(base.wide(spark, d)), GROUP, ["anchor_pos", "step"])


@query("calibration_ece", sql(f"SELECT {G}, sum(gap * n) / sum(n) AS ece FROM ({RANKED}) GROUP BY {G}", "long_all"), "ece")
def _(spark, d):
    return M.expected_calibration_error(M.rank_bins(base.long(base.wide(spark, d)), GROUP, ["anchor_pos", "step"]), GROUP)


QUANTILES = "[" + ", ".join(str(k / 10) for k in range(1, 10)) + "]"


@query("calibration_quantile10", sql(f"SELECT {G}, bin, avg(p) AS mean_p, avg(empty) AS observed, count(*) AS n FROM (SELECT l.*, len(list_filter(q, lambda x: x < p))::INTEGER AS bin FROM long_all l JOIN (SELECT {G}, quantile_cont(p, {QUANTILES}) AS q FROM long_all GROUP BY {G}) USING ({G})) GROUP BY {G}, bin", "long_all"), "mean_p observed")
def _(spark, d):
    return M.quantile_bins(base.long(base.wide(spark, d)), GROUP)


@query("seed_ensemble", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, (slot + persist + recent) / 3 AS p FROM wide_all", "wide_all"), "p")
def _(spark, d):
    rows = base.long(base.wide(spark, d), base.MODELS)
    return rows.groupBy(*KEY, "anchor_pos", "step").agg(F.avg("p").alias("p"))


@query("metrics_by_seed", sql(f"SELECT entity_id, split, avg(brier) AS mean_brier, stddev_samp(brier) AS std_brier, avg(f1) AS mean_f1, stddev_samp(f1) AS std_f1 FROM ({POINT.format(g=G, t='long_all')}) WHERE model <> 'blend' GROUP BY 1, 2", "long_all"), "mean_brier std_brier mean_f1 std_f1")
def _(spark, d):
    m = M.threshold_metrics(base.long(base.wide(spark, d), base.MODELS), GROUP)
    return m.groupBy(*KEY, "split").agg(*(f(c).alias(f"{n}_{c}") for c in ("brier", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


#: Zones as sensors with gaps: the count of a bin, null where it is 0, filled with the last count of the zone.
ZONES = """zone_raw AS MATERIALIZED (SELECT entity_id, pos, bin_start, slot, 'zone1' AS zone, nullif(c1, 0) AS c FROM bins UNION ALL SELECT entity_id, pos, bin_start, slot, 'zone2', nullif(c2, 0) FROM bins),
zone_filled AS MATERIALIZED (SELECT * REPLACE (coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY entity_id, zone ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS c) FROM zone_raw),
zoned AS MATERIALIZED (SELECT z.*, (c > cut)::INTEGER AS occupied, 1 - (c > cut)::INTEGER AS empty FROM zone_filled z JOIN (SELECT entity_id, zone, floor(avg(c)) AS cut FROM zone_filled GROUP BY 1, 2) USING (entity_id, zone))
"""


@query("zone_labels", sql("", "bins").rstrip() + ",\n" + ZONES + "SELECT entity_id, pos, zone, occupied FROM zoned")
def _(spark, d):
    return zones(spark, d).select(*KEY, "pos", "zone", "occupied")


def zones(spark, d):
    b = base.bins(spark, d).select(*KEY, "pos", "bin_start", "slot", F.nullif("c1", F.lit(0)).alias("zone1"), F.nullif("c2", F.lit(0)).alias("zone2"))
    long = b.unpivot([*KEY, "pos", "bin_start", "slot"], ["zone1", "zone2"], "zone", "c")
    filled = B.forward_fill(long, ["c"], [*KEY, "zone"], lead=0)
    cut = filled.groupBy(*KEY, "zone").agg(F.floor(F.avg("c")).alias("cut"))
    occupied = (F.col("c") > F.col("cut")).cast("int")
    return filled.join(cut, [*KEY, "zone"]).withColumns({"occupied": occupied, "empty": 1 - occupied})


def zone_split(spark, d):
    """(training rows before b1, test rows a day behind b2) of all zones."""
    z = zones(spark, d).join(base.anchors(spark, d).select(*KEY, "b1", "b2").distinct(), KEY)
    return z.where("bin_start < b1"), z.where("bin_start >= b2 + interval 24 hours")


HELD = """, zslots AS MATERIALIZED (SELECT entity_id, zone, slot, sum(z.empty) AS e, count(*) AS n FROM zoned z JOIN bounds USING (entity_id) WHERE bin_start < b1 GROUP BY 1, 2, 3),
zscored AS MATERIALIZED (SELECT t.entity_id, t.zone AS held_out, t.empty, coalesce(s.p, m.p) AS p FROM zoned t JOIN bounds b ON b.entity_id = t.entity_id
  LEFT JOIN (SELECT t.entity_id, t.zone, s.slot, sum(e) / sum(n) AS p FROM (SELECT DISTINCT entity_id, zone FROM zslots) t JOIN zslots s ON s.entity_id = t.entity_id AND s.zone <> t.zone GROUP BY 1, 2, 3) s ON s.entity_id = t.entity_id AND s.zone = t.zone AND s.slot = t.slot
  JOIN (SELECT t.entity_id, t.zone, sum(e) / sum(n) AS p FROM (SELECT DISTINCT entity_id, zone FROM zslots) t JOIN zslots s ON s.entity_id = t.entity_id AND s.zone <> t.zone GROUP BY 1, 2) m ON m.entity_id = t.entity_id AND m.zone = t.zone WHERE t.bin_start >= b2 + INTERVAL '24 hours')
"""
HG = "entity_id, held_out"


@query("leave_one_zone_out", sql("", "bounds").rstrip() + ",\n" + ZONES.rstrip() + HELD + f"SELECT * FROM ({POINT.format(g=HG, t='zscored')}) JOIN ({AP.format(g=HG, p=CLIP, t='zscored')}) USING ({HG})", METRICS + " average_precision auroc")
def _(spark, d):
    """The slot average of all other zones, or their mean where they lack the slot, on the held-out zone."""
    train, test = zone_split(spark, d)
    names = train.select(*KEY, F.col("zone").alias("held_out")).distinct()
    sums = train.groupBy(*KEY, "zone", "slot").agg(F.sum("empty").alias("e"), F.count("*").alias("n"))
    others = names.join(sums, KEY).where("zone <> held_out")
    slots = others.groupBy(*KEY, "held_out", "slot").agg((F.sum("e") / F.sum("n")).alias("slot_mean"))
    mean = others.groupBy(*KEY, "held_out").agg((F.sum("e") / F.sum("n")).alias("mean"))
    rows = test.withColumnRenamed("zone", "held_out").join(slots, [*KEY, "held_out", "slot"], "left").join(mean, [*KEY, "held_out"])
    return M.model_metrics(rows.withColumn("p", F.coalesce("slot_mean", "mean")), [*KEY, "held_out"])


@query("leave_one_zone_out_gbt")
def _(spark, d):
    """Boosted trees on calendar features alone, fitted on the other zones."""
    train, test = zone_split(spark, d)
    features = S.time_features("bin_start")
    rows = materialise(train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test"))).select(*KEY, "zone", "split", "empty", *(c.alias(n) for n, c in features.items())), "zones")
    out = None
    for zone in ("zone1", "zone2"):
        use = rows.where((F.col("split") == "train") == (F.col("zone") != zone))
        one = M.model_metrics(ML.fit_and_score(use, list(features), ML.gbt), KEY).withColumn("held_out", F.lit(zone))
        out = one if out is None else out.unionByName(one)
    return out


@query("label_transitions", sql("SELECT entity_id, day, sum(abs(occupied - prev))::BIGINT AS transitions FROM (SELECT entity_id, bin_start::DATE AS day, occupied, coalesce(lag(occupied) OVER (PARTITION BY entity_id, bin_start::DATE ORDER BY pos), occupied) AS prev FROM bins) GROUP BY 1, 2", "bins"))
def _(spark, d):
    b = base.bins(spark, d).withColumn("day", F.to_date("bin_start"))
    w = Window.partitionBy(*KEY, "day").orderBy("pos")
    return b.withColumn("t", F.abs(F.col("occupied") - F.coalesce(F.lag("occupied").over(w), "occupied"))).groupBy(*KEY, "day").agg(F.sum("t").alias("transitions"))
