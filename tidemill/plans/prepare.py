"""Queries: scans, scalar functions, bins, lags and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.operators import bins as B
from tidemill.operators import features as L
from tidemill.operators.chunks import asof_join
from tidemill.operators.policy import threshold_grid
from tidemill.plans import base
from tidemill.plans.base import KEY, sql
from tidemill.plans.registry import query
from tidemill.sources.sensors import to_long, to_wide

SENSORS = ("hvac", "light", "sensor")


@query("scan_pruned", "SELECT event_type, value FROM events WHERE value > 50", "value")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_type", "value").where("value > 50")


@query("sensor_long", sql("SELECT entity_id, bin_start, s AS sensor, value FROM (UNPIVOT (SELECT entity_id, bin_start, hvac, light, sensor AS error_mean FROM raw) ON hvac, light, error_mean INTO NAME s VALUE value)", "raw"), "value")
def _(spark, d):
    raw = base.raw_bins(spark, d).withColumnRenamed("sensor", "error_mean")
    return to_long(raw, [*KEY, "bin_start"], ["hvac", "light", "error_mean"])


@query("sensor_wide", sql("SELECT entity_id, bin_start, hvac, light FROM raw WHERE hvac IS NOT NULL OR light IS NOT NULL", "raw"), "hvac light")
def _(spark, d):
    return to_wide(to_long(base.raw_bins(spark, d), [*KEY, "bin_start"], ["hvac", "light"]), [*KEY, "bin_start"], ["hvac", "light"])


COVERAGE = " UNION ALL ".join(
    f"SELECT '{s}' AS source, count(*) FILTER (event_type = '{k}') AS raw_rows, min(ts) FILTER (event_type = '{k}') AS first_time, max(ts) FILTER (event_type = '{k}') AS last_time, (SELECT avg(({s} IS NOT NULL)::INTEGER) FROM bins) AS coverage FROM rd"
    for s, k in (("hvac", "purchase"), ("light", "signup"), ("sensor", "error"))
)


@query("source_coverage", sql(COVERAGE, "bins"), "coverage")
def _(spark, d):
    kinds = spark.createDataFrame([("purchase", "hvac"), ("signup", "light"), ("error", "sensor")], "event_type string, source string")
    rows = base.readings(spark, d).join(F.broadcast(kinds), "event_type").groupBy("source")
    ends = rows.agg(F.count("*").alias("raw_rows"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"))
    b = base.bins(spark, d).agg(*(F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in SENSORS))
    return ends.join(b.unpivot([], list(SENSORS), "source", "coverage"), "source")


@query("row_sum_min1", sql("SELECT entity_id, pos, CASE WHEN hvac IS NOT NULL OR light IS NOT NULL THEN coalesce(hvac, 0) + coalesce(light, 0) END AS total FROM bins", "bins"), "total")
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", S.row_sum_min1("hvac", "light").alias("total"))


@query("row_mean_skipna", sql("SELECT entity_id, pos, list_avg(list_filter([hvac, light, sensor], lambda x: x IS NOT NULL)) AS mean FROM bins", "bins"), "mean")
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", S.row_mean_skipna(*SENSORS).alias("mean"))


FEATURES = """SELECT entity_id, pos, sin(2 * pi() * (hour(t) + minute(t) / 60) / 24) AS hour_sin, cos(2 * pi() * (hour(t) + minute(t) / 60) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(t) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(t) - 1) / 7) AS dow_cos, sin(2 * pi() * (month(t) - 1) / 12) AS month_sin, cos(2 * pi() * (month(t) - 1) / 12) AS month_cos,
  (isodow(t) >= 6)::INTEGER::DOUBLE AS is_weekend, (isodow(t) < 6 AND hour(t) >= 7 AND hour(t) < 19)::INTEGER::DOUBLE AS is_business_hour
  FROM (SELECT *, bin_start AS t FROM bins)"""


@query("time_features", sql(FEATURES, "bins"), "hour_sin hour_cos dow_sin dow_cos month_sin month_cos")
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", *(c.alias(n) for n, c in S.time_features("bin_start").items()))


HOLIDAYS = "SELECT DISTINCT bin_start::DATE AS day, (bin_start::DATE IN (DATE '2024-01-01', DATE '2024-01-15'))::INTEGER AS is_holiday FROM bins"


@query("holiday_flag", sql(HOLIDAYS, "bins"))
def _(spark, d):
    days = base.bins(spark, d).select(F.to_date("bin_start").alias("day")).distinct()
    flags = S.us_holidays(spark, 2023, 2025).withColumn("h", F.lit(1))
    return days.join(F.broadcast(flags), "day", "left").select("day", F.coalesce("h", F.lit(0)).alias("is_holiday"))


@query("slot_index", sql("SELECT entity_id, pos, slot FROM bins", "bins"))
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", "slot")


@query("week_floor", sql("SELECT DISTINCT bin_start::DATE AS day, date_trunc('week', bin_start)::TIMESTAMP AS week FROM bins", "bins"))
def _(spark, d):
    return base.bins(spark, d).select(F.to_date("bin_start").alias("day"), S.week_floor("bin_start").alias("week")).distinct()


@query("occupied_label", sql("SELECT entity_id, pos, c1, cut, occupied, empty FROM bins", "bins"))
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", "c1", "cut", "occupied", "empty")


@query("clip_score", sql("SELECT event_id, greatest(1e-6, least(1 - 1e-6, value / 100)) AS p FROM events"), "p")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.clip_score(F.col("value") / 100).alias("p"))


@query("interval_kwh", sql("SELECT entity_id, pos, kwh FROM bins", "bins"), "kwh")
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", "kwh")


ASSUMED = "(VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {t}::DOUBLE)" for n, a, b, c, t in S.LOAD_ASSUMPTIONS) + ") a(assumption, wh, wl, wm, wt)"
WEIGHTED = "greatest(wh * coalesce(hvac, 0) + wl * coalesce(light, 0) + wm * coalesce(sensor, 0) + wt * (coalesce(hvac, 0) + coalesce(light, 0) + coalesce(sensor, 0)), 0) * 0.25"


def weighted_kwh(bins, spark):
    """Bins under all accounting assumptions; the third sensor stands for plug loads, the sum of all for the total."""
    grid = F.broadcast(spark.createDataFrame(S.LOAD_ASSUMPTIONS, "assumption string, wh double, wl double, wm double, wt double"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    load = F.col("wh") * z("hvac") + F.col("wl") * z("light") + F.col("wm") * z("sensor") + F.col("wt") * (z("hvac") + z("light") + z("sensor"))
    return bins.join(grid).withColumn("kwh", S.interval_kwh(load)).drop("wh", "wl", "wm", "wt")


@query("weighted_load", sql(f"SELECT entity_id, assumption, round(sum({WEIGHTED}) + 1e-8, 6) AS kwh FROM bins JOIN {ASSUMED} ON TRUE GROUP BY 1, 2", "bins"), "kwh")
def _(spark, d):
    return weighted_kwh(base.bins(spark, d), spark).groupBy(*KEY, "assumption").agg(F.round(F.sum("kwh") + 1e-8, 6).alias("kwh"))  # 1e-8: sums that lie midway round alike in any order of adding


@query("bin_bounds", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, anchor_time + INTERVAL '15 minutes' AS issue_time, anchor_time + step * INTERVAL '15 minutes' AS target_start, anchor_time + (step + 1) * INTERVAL '15 minutes' AS target_end FROM wide_mid", "wide_mid"))
def _(spark, d):
    w = base.wide(spark, d, midnight=True)
    bounds = S.bin_bounds("anchor_time", "step")
    return w.select("entity_id", "anchor_pos", "step", *(bounds[n].alias(n) for n in ("issue_time", "target_start", "target_end")))


@query("midnight_filter", sql("SELECT 'all' AS given, entity_id, split, pos, bin_start FROM anchors WHERE hour(bin_start) = 0 AND minute(bin_start) = 0 UNION ALL SELECT 'without_midnight', entity_id, split, pos, bin_start FROM (SELECT *, min(pos) OVER (PARTITION BY entity_id) AS first FROM anchors WHERE hour(bin_start) > 0 OR minute(bin_start) > 0) WHERE (pos - first) % 96 = 0", "anchors"))
def _(spark, d):
    """Daily anchors of all anchors, and of those that are left where none is at midnight."""
    a = base.anchors(spark, d).select(*KEY, "split", "pos", "bin_start")
    rest = a.where(~S.is_midnight("bin_start"))
    both = [L.daily_anchors(x, KEY).withColumn("given", F.lit(n)) for n, x in (("all", a), ("without_midnight", rest))]
    return both[0].unionByName(both[1])


@query("percent_label", sql("SELECT DISTINCT delta, round(100 * delta)::INTEGER::VARCHAR || '%' AS label FROM chosen", "chosen"), "delta")
def _(spark, d):
    from tidemill.plans.decide import chosen

    return chosen(spark, d).select("delta", S.percent_label("delta").alias("label")).distinct()


@query("slug_labels", "SELECT DISTINCT p_brand, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_brand", S.slugify("p_brand").alias("slug")).distinct()


@query("joined_labels", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("kinds"))


@query("near_equal", sql("SELECT event_id, thr_idx, abs(value / 100 - threshold) AS distance FROM (SELECT event_id, value, round((value * 10 - 50) / 25)::INTEGER AS k FROM events) JOIN grid ON k = thr_idx WHERE abs(value / 100 - threshold) <= 1e-3 + 1e-3 * abs(threshold)", "grid"), "distance")
def _(spark, d):
    """Events whose value in hundredths equals a threshold up to a tolerance: joined by the nearest index, then compared."""
    k = F.round((F.col("value") * 10 - 50) / 25).cast("int")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("value") / 100).alias("v"), k.alias("thr_idx"))
    near = e.join(F.broadcast(threshold_grid(spark)), "thr_idx").where(S.near_equal("v", "threshold", 1e-3, 1e-3))
    return near.select("event_id", "thr_idx", F.abs(F.col("v") - F.col("threshold")).alias("distance"))


@query("resample_mean", "SELECT user_id % 2 AS entity_id, time_bucket(INTERVAL '15 minutes', ts) AS bin_start, avg(value) AS value FROM events GROUP BY 1, 2", "value")
def _(spark, d):
    return B.resample_mean(base.readings(spark, d), KEY)


@query("resample_label", "SELECT user_id % 2 AS entity_id, time_bucket(INTERVAL '15 minutes', ts) AS bin_start, avg(value) AS count_mean, max(value) AS count_max, (max(value) > 60)::INTEGER AS occupied, 1 - (max(value) > 60)::INTEGER AS empty FROM events WHERE event_type = 'view' GROUP BY 1, 2", "count_mean count_max")
def _(spark, d):
    return B.resample_label(base.readings(spark, d).where("event_type = 'view'"), KEY, "value", 60.0)


@query("bin_spine", sql("SELECT entity_id, bin_start, pos FROM full_bins", "full_bins"))
def _(spark, d):
    return B.bin_spine(base.raw_bins(spark, d), KEY)


@query("align_sources", sql("SELECT entity_id, pos, hvac, light, sensor FROM bins", "bins"), "hvac light sensor")
def _(spark, d):
    return base.bins(spark, d).select(*KEY, "pos", *SENSORS)


FFILL = sql("SELECT entity_id, pos, " + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER w, 0) AS {c}" for c in SENSORS) + ", empty FROM bins WINDOW w AS (PARTITION BY entity_id ORDER BY pos ROWS UNBOUNDED PRECEDING)", "bins")


@query("forward_fill", FFILL, "hvac light sensor")
def _(spark, d):
    return B.forward_fill(base.bins(spark, d), SENSORS, KEY).select(*KEY, "pos", *SENSORS, "empty")


@query("forward_fill_chunked", FFILL, "hvac light sensor")
def _(spark, d):
    return B.forward_fill_chunked(base.bins(spark, d), SENSORS, KEY, chunk=96).select(*KEY, "pos", *SENSORS, "empty")


ASOF_SQL = """WITH rd AS (SELECT user_id % 2 AS entity_id, event_id, ts, event_type, value FROM events),
heard AS (SELECT entity_id, ts, max_by(value, event_id) AS value FROM rd WHERE event_type = 'error' GROUP BY 1, 2)
SELECT p.entity_id, p.event_id, p.ts, h.ts AS sensor_time, h.value AS sensor, CASE WHEN h.ts >= p.ts - INTERVAL '30 minutes' THEN h.value END AS fresh_sensor
FROM (SELECT * FROM rd WHERE event_type = 'purchase') p ASOF LEFT JOIN heard h ON h.entity_id = p.entity_id AND h.ts {} p.ts"""


def _asof(spark, d, **more):
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("entity_id", F.col("user_id") % base.ENTITIES)
    bought = events.where("event_type = 'purchase'").select(*KEY, "event_id", "ts")
    heard = events.where("event_type = 'error'").select(*KEY, "ts", "value", "event_id")
    found = asof_join(bought, heard, KEY, {"value": "sensor"}, matched="sensor_time", tie=["event_id"], **more)
    fresh = F.when(F.col("sensor_time") >= F.col("ts") - F.expr("interval 30 minutes"), F.col("sensor"))
    return found.withColumn("fresh_sensor", fresh)


@query("asof_sensor", ASOF_SQL.format("<="), "sensor fresh_sensor")
def _(spark, d):
    """Each purchase with the last reading of the sensor at or before it, and with that reading if it is no older than half an hour."""
    return _asof(spark, d)


@query("asof_sensor_before", ASOF_SQL.format("<"), "sensor fresh_sensor")
def _(spark, d):
    """The same with readings at the very time left out."""
    return _asof(spark, d, exact=False)


@query("missing_before_fill", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INTEGER) AS missing_rate FROM bins" for c in SENSORS), "bins"), "missing_rate")
def _(spark, d):
    return B.missing_shares(base.bins(spark, d), SENSORS)


GATED = "SELECT entity_id, pos, source, CASE WHEN share >= 0.25 THEN value END AS value, (share >= 0.25)::INTEGER AS included FROM (SELECT entity_id, pos, 'sensor' AS source, sensor AS value, (SELECT avg((sensor IS NOT NULL)::INTEGER) FROM bins) AS share FROM bins UNION ALL SELECT entity_id, pos, 'rare', rare, avg((rare IS NOT NULL)::INTEGER) OVER () FROM (SELECT entity_id, pos, CASE WHEN pos % 10 = 0 THEN sensor END AS rare FROM bins))"


@query("co2_gate", sql(GATED, "bins"), "value")
def _(spark, d):
    """A sensor that enough bins have, and one that is there in a tenth of them at most, after the gate."""
    b = base.bins(spark, d).select(*KEY, "pos", F.col("sensor").alias("value"))
    rare = b.withColumn("value", F.when(F.col("pos") % 10 == 0, F.col("value")))
    both = [B.gated(x, ["value"]).withColumn("source", F.lit(n)) for n, x in (("sensor", b), ("rare", rare))]
    return both[0].unionByName(both[1])


@query("assign_position", sql("SELECT entity_id, bin_start, pos, (pos = date_diff('minute', min(bin_start) OVER (PARTITION BY entity_id), bin_start) // 15)::INTEGER AS gap_free FROM bins", "bins"))
def _(spark, d):
    b = base.bins(spark, d)
    b = b.withColumn("lo", F.min("bin_start").over(Window.partitionBy(*KEY)))
    return b.select(*KEY, "bin_start", "pos", (F.col("pos") == F.expr("timestampdiff(MINUTE, lo, bin_start) div 15")).cast("int").alias("gap_free"))


@query("future_explode", sql("SELECT entity_id, pos, step::INTEGER AS step, pos + step AS target_pos FROM anchors JOIN range(1, 97) r(step) ON TRUE WHERE split = 'test'", "anchors"))
def _(spark, d):
    return B.future_explode(base.anchors(spark, d).where("split = 'test'").select(*KEY, "pos"))


@query("gather_targets", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, target_time, empty, kwh FROM wide_mid", "wide_mid"), "kwh")
def _(spark, d):
    return base.wide(spark, d, midnight=True).select("entity_id", "anchor_pos", "step", "target_time", "empty", "kwh")


@query("history_window", sql("SELECT entity_id, pos, list_sum(h)::BIGINT AS total, len(h)::INTEGER AS n, h[1] AS first FROM (SELECT entity_id, pos, list(empty) OVER (PARTITION BY entity_id ORDER BY pos ROWS 95 PRECEDING) AS h FROM bins)", "bins"))
def _(spark, d):
    h = B.history_window(base.bins(spark, d), "empty", KEY)
    return h.select(*KEY, "pos", F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("history").alias("n"), F.col("history")[0].alias("first"))


LAGS = (1, 2, 4, 96, 672)
LAG_SQL = "SELECT entity_id, split, pos, " + ", ".join(f"coalesce(l{k}, avg(l{k}) OVER (PARTITION BY entity_id, split), 0) AS empty_lag_{k}" for k in LAGS) + " FROM (SELECT a.entity_id, a.split, a.pos, " + ", ".join(f"b{k}.empty AS l{k}" for k in LAGS) + " FROM anchors a " + " ".join(f"LEFT JOIN bins b{k} ON b{k}.entity_id = a.entity_id AND b{k}.pos = a.pos - {k}" for k in LAGS) + ")"


@query("lag_feature", sql(LAG_SQL, "anchors"), " ".join(f"empty_lag_{k}" for k in LAGS))
def _(spark, d):
    cols = [f"empty_lag_{k}" for k in LAGS]
    lagged = L.lags(base.bins(spark, d), "empty", LAGS, KEY).select(*KEY, "pos", *cols)
    a = base.anchors(spark, d).select(*KEY, "split", "pos").join(lagged, [*KEY, "pos"])
    return L.fill_by_split(a, cols, KEY).select(*KEY, "split", "pos", *cols)


WIDTHS = (4, 24, 96)
ROLL_SQL = "SELECT a.entity_id, a.split, a.pos, " + ", ".join(f"coalesce(m{k}, avg(m{k}) OVER (PARTITION BY a.entity_id, a.split), 0) AS c1_mean_{k}" for k in WIDTHS) + " FROM anchors a JOIN (SELECT entity_id, pos, " + ", ".join(f"CASE WHEN pos >= {k} THEN avg(c1) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS m{k}" for k in WIDTHS) + " FROM bins) b USING (entity_id, pos)"


@query("rolling_mean_shifted", sql(ROLL_SQL, "anchors"), " ".join(f"c1_mean_{k}" for k in WIDTHS))
def _(spark, d):
    cols = [f"c1_mean_{k}" for k in WIDTHS]
    rolled = L.rolling_means(base.bins(spark, d), "c1", WIDTHS, KEY).select(*KEY, "pos", *cols)
    a = base.anchors(spark, d).select(*KEY, "split", "pos").join(rolled, [*KEY, "pos"])
    return L.fill_by_split(a, cols, KEY).select(*KEY, "split", "pos", *cols)


@query("same_time_yesterday", sql("SELECT w.entity_id, w.anchor_pos, w.step::INTEGER AS step, b.occupied AS yesterday FROM wide_mid w JOIN bins b ON b.entity_id = w.entity_id AND b.pos = w.target_pos - 96", "wide_mid"))
def _(spark, d):
    b = base.bins(spark, d).select(*KEY, (F.col("pos") + 96).alias("target_pos"), F.col("occupied").alias("yesterday"))
    return base.wide(spark, d, midnight=True).join(b, [*KEY, "target_pos"]).select(*KEY, "anchor_pos", "step", "yesterday")


CALENDAR = S.TIME_FEATURES
TABULAR = [*(f"empty_lag_{k}" for k in LAGS), *(f"c1_mean_{k}" for k in WIDTHS), *SENSORS, "step_share", "yesterday", *CALENDAR]


def anchor_features(b, assigned):
    """(entity_id, split, pos) of the anchors in ``assigned`` with lags, rolling means and sensors."""
    filled = B.forward_fill_chunked(b, SENSORS, KEY)
    lag_cols, roll_cols = [f"empty_lag_{k}" for k in LAGS], [f"c1_mean_{k}" for k in WIDTHS]
    known = L.rolling_means(L.lags(filled, "empty", LAGS, KEY), "c1", WIDTHS, KEY)
    return L.fill_by_split(known.join(assigned, [*KEY, "pos"]), [*lag_cols, *roll_cols], KEY).select(*KEY, "split", "pos", *lag_cols, *roll_cols, *SENSORS)


def with_targets(b, steps):
    """Rows of anchors and steps (pos, step, target_pos) with the label and what is known of the target beforehand."""
    at = steps.withColumnRenamed("pos", "anchor_pos").withColumn("step_share", F.col("step") / 96)
    target = b.select(*KEY, F.col("pos").alias("target_pos"), "empty", *(c.alias(n) for n, c in S.time_features("bin_start").items()))
    yesterday = b.select(*KEY, (F.col("pos") + 96).alias("target_pos"), F.col("occupied").alias("yesterday"))
    return at.join(target, [*KEY, "target_pos"]).join(yesterday, [*KEY, "target_pos"])


def feature_rows(b, assigned):
    """Feature rows of anchors and steps: lags, rolling means, sensors at the anchor, yesterday's label, calendar of the target.

    ``assigned``: (entity_id, pos, split) of the anchors to use.
    """
    return with_targets(b, B.future_explode(anchor_features(b, assigned)))


#: Rows of each entity and split that a fit on all anchors sees at most.
FIT_ROWS = 100_000


@base.once
def all_anchor_features(spark, d):
    return anchor_features(base.bins(spark, d), base.anchors(spark, d).select(*KEY, "pos", "split"))


def sampled_rows(spark, d, seed, rows=FIT_ROWS):
    """Feature rows of training and validation, a sample of all anchors and steps: half with each label where there are enough.

    Anchors and steps are sampled with their labels alone; only what is taken gets features.
    """
    b = base.bins(spark, d)
    pairs = B.future_explode(base.anchors(spark, d).where("split <> 'test'").select(*KEY, "split", "pos"))
    labelled = pairs.join(b.select(*KEY, F.col("pos").alias("target_pos"), "empty"), [*KEY, "target_pos"])
    mixed = F.xxhash64(F.lit(seed), *KEY, "pos", "step")
    taken = L.stratified_sample(labelled, "empty", rows, [mixed, "pos", "step"], [*KEY, "split"]).drop("empty")
    return with_targets(b, taken.join(all_anchor_features(spark, d), [*KEY, "split", "pos"]))


def held_out_rows(spark, d):
    """Feature rows of all validation and test anchors."""
    return with_targets(base.bins(spark, d), B.future_explode(all_anchor_features(spark, d).where("split <> 'train'")))


@base.once
def tabular(spark, d):
    """Feature rows of the midnight anchors of all splits."""
    daily = base.anchors(spark, d).where(S.is_midnight("bin_start")).select(*KEY, "pos", "split")
    return feature_rows(base.bins(spark, d), daily)


def tabular_sql():
    means = ", ".join([f"coalesce(l{k}, avg(l{k}) OVER s, 0) AS empty_lag_{k}" for k in LAGS] + [f"coalesce(m{k}, avg(m{k}) OVER s, 0) AS c1_mean_{k}" for k in WIDTHS])
    known = ", ".join([f"lag(empty, {k}) OVER w AS l{k}" for k in LAGS] + [f"CASE WHEN pos >= {k} THEN avg(c1) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS m{k}" for k in WIDTHS] + [f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY entity_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS {c}" for c in SENSORS])
    own = ", ".join(c for c in TABULAR if c.startswith(("empty_lag", "c1_mean")) or c in SENSORS)
    return f""", known AS MATERIALIZED (SELECT entity_id, pos, {known} FROM bins WINDOW w AS (PARTITION BY entity_id ORDER BY pos)),
    daily AS MATERIALIZED (SELECT entity_id, split, pos, {means}, {", ".join(SENSORS)} FROM known JOIN (SELECT entity_id, pos, split FROM anchors WHERE hour(bin_start) = 0 AND minute(bin_start) = 0) USING (entity_id, pos) WINDOW s AS (PARTITION BY entity_id, split)),
    calendar AS MATERIALIZED ({FEATURES}), past AS MATERIALIZED (SELECT entity_id, pos + 96 AS pos, occupied AS yesterday FROM bins),
    targets AS MATERIALIZED (SELECT entity_id, pos AS target_pos, empty, yesterday, {", ".join(CALENDAR)} FROM (SELECT entity_id, pos, empty FROM bins) JOIN past USING (entity_id, pos) JOIN calendar USING (entity_id, pos)),
    steps AS MATERIALIZED (SELECT entity_id, split, pos AS anchor_pos, step::INTEGER AS step, pos + step AS target_pos, {own}, step / 96 AS step_share FROM daily JOIN range(1, 97) r(step) ON TRUE)
    SELECT entity_id, split, anchor_pos, step, empty, {", ".join(TABULAR)} FROM steps JOIN targets USING (entity_id, target_pos)"""


@query("tabular_features", sql("", "anchors").rstrip() + tabular_sql(), " ".join(c for c in TABULAR if c != "yesterday"))
def _(spark, d):
    return tabular(spark, d).select(*KEY, "split", "anchor_pos", "step", "empty", *TABULAR)


@query("chrono_split", sql("SELECT entity_id, pos, split FROM anchors", "anchors"))
def _(spark, d):
    return base.anchors(spark, d).select(*KEY, "pos", "split")


SUMMARY = "SELECT entity_id, split, count(*) AS anchor_count, count(*) * 96 AS forecast_rows, min(bin_start) - INTERVAL '1425 minutes' AS first_history, min(bin_start) AS first_anchor, max(bin_start) AS last_anchor, min(bin_start) + INTERVAL '15 minutes' AS first_target, max(bin_start) + INTERVAL '1 day' AS last_target FROM anchors GROUP BY 1, 2"


def split_summary(spark, d):
    t = F.expr
    return base.anchors(spark, d).groupBy(*KEY, "split").agg(
        F.count("*").alias("anchor_count"), (F.count("*") * 96).alias("forecast_rows"), (F.min("bin_start") - t("interval 1425 minutes")).alias("first_history"), F.min("bin_start").alias("first_anchor"),
        F.max("bin_start").alias("last_anchor"), (F.min("bin_start") + t("interval 15 minutes")).alias("first_target"), (F.max("bin_start") + t("interval 1 day")).alias("last_target"),
    )


query("split_summary", sql(SUMMARY, "anchors"))(split_summary)


@query("split_gap_audit", sql(f"SELECT entity_id, a.split AS earlier, b.split AS later, date_diff('minute', a.last_target, b.first_history) / 60 AS gap_hours, (date_diff('minute', a.last_target, b.first_history) >= 1440)::INTEGER AS ok FROM ({SUMMARY}) a JOIN ({SUMMARY}) b USING (entity_id) WHERE (a.split, b.split) IN (('train', 'val'), ('val', 'test'))", "anchors"), "gap_hours")
def _(spark, d):
    s = split_summary(spark, d)
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    w = Window.partitionBy(*KEY).orderBy(order)
    pair = s.select(*KEY, F.col("split").alias("earlier"), "last_target", F.lead("split").over(w).alias("later"), F.lead("first_history").over(w).alias("begin"))
    minutes = F.expr("timestampdiff(MINUTE, last_target, begin)")
    return pair.where("later is not null").select(*KEY, "earlier", "later", (minutes / 60).alias("gap_hours"), (minutes >= 1440).cast("int").alias("ok"))


@query("split_class_rates", sql("SELECT entity_id, split, count(*) AS rows, avg(empty) AS empty_rate FROM wide_all GROUP BY 1, 2", "wide_all"), "empty_rate")
def _(spark, d):
    return base.wide(spark, d).groupBy(*KEY, "split").agg(F.count("*").alias("rows"), F.avg("empty").alias("empty_rate"))


FOLDS = """SELECT entity_id, fold, role, count(*) AS anchors, min(pos) AS first_pos, max(pos) AS last_pos FROM (
  SELECT b.entity_id, fold, pos, CASE WHEN bin_start + INTERVAL '1 day' < e THEN 'train' WHEN bin_start - INTERVAL '1425 minutes' >= e + INTERVAL '1 day' AND bin_start + INTERVAL '1 day' < e + INTERVAL '21 days' THEN 'val' END AS role
  FROM bins b JOIN sizes USING (entity_id) JOIN (SELECT x.entity_id, fold, date_trunc('week', bin_start)::TIMESTAMP AS e FROM bins x JOIN sizes USING (entity_id) JOIN (VALUES (1, 0.5::DOUBLE), (2, 0.6::DOUBLE), (3, 0.7::DOUBLE)) f(fold, share) ON x.pos = floor(n * share)::BIGINT) USING (entity_id) WHERE pos >= 95 AND pos < n - 96)
  WHERE role IS NOT NULL GROUP BY 1, 2, 3"""


@query("rolling_origin_folds", sql(f"SELECT * FROM ({FOLDS}) x WHERE (SELECT count(*) FROM ({FOLDS}) y WHERE y.entity_id = x.entity_id AND y.fold = x.fold AND anchors >= 100) = 2", "sizes"))
def _(spark, d):
    f = L.rolling_origin_folds(base.bins(spark, d), KEY)
    return f.groupBy(*KEY, "fold", "role").agg(F.count("*").alias("anchors"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


QUOTA = """SELECT entity_id, pos, occupied FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, occupied ORDER BY md5(concat_ws('|', entity_id, pos)), pos) AS rk, count(*) FILTER (occupied = 1) OVER (PARTITION BY entity_id) AS np, count(*) FILTER (occupied = 0) OVER (PARTITION BY entity_id) AS nn FROM bins)
  WHERE (occupied = 0 AND rk <= least(nn, 400 - least(np, 200))) OR (occupied = 1 AND rk <= least(np, 400 - least(nn, 400 - least(np, 200))))"""


@query("stratified_sample", sql(QUOTA, "bins"))
def _(spark, d):
    """400 bins of each entity, half of them occupied where it has so many."""
    mixed = F.md5(F.concat_ws("|", F.col("entity_id").cast("string"), F.col("pos").cast("string")).cast("binary"))
    return L.stratified_sample(base.bins(spark, d), "occupied", 400, [mixed, "pos"], KEY).select(*KEY, "pos", "occupied")


@query("train_scaler", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) < 1e-6 THEN 1 ELSE stddev_pop({c}) END AS std FROM anchors WHERE split = 'train'" for c in ("c1", "c2", "kwh")), "anchors"), "mean std")
def _(spark, d):
    return L.train_scaler(base.anchors(spark, d), ["c1", "c2", "kwh"])


@query("class_weight", sql("SELECT entity_id, split, greatest(0.25, least(8, sum(occupied) / greatest(sum(empty), 1))) AS pos_weight FROM anchors GROUP BY 1, 2", "anchors"), "pos_weight")
def _(spark, d):
    return L.class_weight(base.anchors(spark, d), "empty", [*KEY, "split"])
