"""The tables that the registered queries start from, derived from ``events``, and the same in SQL.

``events`` plays the sensor streams of two entities: views per bin are zone 1's count, clicks zone 2's; purchases and
signups are two meters, the mean value of errors a sensor with gaps.  A bin is occupied if its count is above a cut: in
opening hours (Monday to Friday, 8 to 18) the floor of the entity's mean, else that of its mean plus two and a half
standard deviations.  So the label has a weekly rhythm, though the events have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalar import interval_kwh, is_midnight, row_mean_skipna, row_sum_min1, slot_index
from tidemill.operators import bins as B
from tidemill.operators import features as L
from tidemill.sources.scratch import once

ENTITIES = 2
KEY = ["entity_id"]
HORIZON_KEY = ["entity_id", "anchor_pos"]
MODELS = ("slot", "persist", "recent")
#: Fixed weights of the blend that stands for a selected one where a query is not about selecting it.
BLEND = {"slot": 0.5, "persist": 0.3, "recent": 0.2}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select((F.col("user_id") % ENTITIES).alias("entity_id"), "ts", "event_type", "value")


def raw_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    value = lambda k: F.when(kind == k, F.col("value"))
    aggs = {
        "c1": F.count_if(kind == "view"), "c2": F.count_if(kind == "click"), "hvac": F.sum(value("purchase")),
        "light": F.sum(value("signup")), "sensor": F.avg(value("error")),
    }
    return B.resample(readings(spark, sf_dir), KEY, aggs)


@once
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, bin_start, pos, c1, c2, hvac, light, sensor, cut, occupied, empty, slot, kwh)."""
    raw = raw_bins(spark, sf_dir)
    full = B.align(B.bin_spine(raw, KEY), [raw], KEY).fillna(0, ["c1", "c2"])
    cuts = full.groupBy(*KEY).agg(F.floor(F.avg("c1")).alias("low_cut"), F.floor(F.avg("c1") + 2.5 * F.stddev_samp("c1")).alias("high_cut"))
    opened = (F.weekday("bin_start") < 5) & F.hour("bin_start").between(8, 17)
    out = full.join(cuts, KEY).withColumn("cut", F.when(opened, F.col("low_cut")).otherwise(F.col("high_cut"))).drop("low_cut", "high_cut")
    occupied = (F.col("c1") > F.col("cut")).cast("int")
    return out.withColumns({"occupied": occupied, "empty": 1 - occupied, "slot": slot_index("bin_start"), "kwh": interval_kwh(row_sum_min1("hvac", "light"))})


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that are anchors, with their split and its bounds."""
    return L.chrono_split(bins(spark, sf_dir), KEY)


def components(b: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target scores by position, anchor scores by position): three forecasts that need no fitted model.

    slot: mean of empty by quarter hour of the week before b1; persist: mean of the labels one to seven days before
    the target; recent: mean of the day before the anchor.
    """
    bounds = a.select(*KEY, "b1").distinct()
    train = b.join(bounds, KEY).where("bin_start < b1")
    slots = train.groupBy(*KEY, "slot").agg(F.avg("empty").alias("slot_mean"))
    mean = train.groupBy(*KEY).agg(F.avg("empty").alias("train_mean"))
    back = [96 * k for k in range(1, 8)]
    week = L.lags(b, "empty", back, KEY).withColumn("_persist", row_mean_skipna(*(f"empty_lag_{k}" for k in back)))
    target = week.join(slots, [*KEY, "slot"], "left").join(mean, KEY)
    target = target.select(
        *KEY, F.col("pos").alias("target_pos"), F.col("bin_start").alias("target_time"), "empty", "kwh",
        F.round(F.coalesce("slot_mean", "train_mean"), 9).alias("slot"), F.round(F.coalesce("_persist", "train_mean"), 9).alias("persist"),
    )
    recent = L.rolling_means(b, "empty", [96], KEY).select(*KEY, F.col("pos").alias("anchor_pos"), F.round("empty_mean_96", 9).alias("recent"))
    return target, recent


@once
def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each bin, as target and as anchor: the bin's scores, its label and load, and the split that it anchors."""
    b = bins(spark, sf_dir)
    target, recent = components(b, L.chrono_split(b, KEY))
    role = anchors(spark, sf_dir).select(*KEY, F.col("pos").alias("target_pos"), "split")
    mine = target.join(recent.withColumnRenamed("anchor_pos", "target_pos"), [*KEY, "target_pos"])
    return mine.join(role, [*KEY, "target_pos"], "left")


def wide(spark: SparkSession, sf_dir: str, midnight: bool = False, splits: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """A row for each anchor and step with the three scores and their blend as columns."""
    if midnight:
        return midnight_rows(spark, sf_dir).where(F.col("split").isin(*splits))
    return expanded(forecasts(spark, sf_dir), splits)


def expanded(rows: DataFrame, splits: tuple[str, ...], only=None) -> DataFrame:
    """Steps of the anchors in ``rows`` (all, or those that meet ``only``) with what ``rows`` says of their targets."""
    used = rows.where(F.col("split").isin(*splits))
    used = used if only is None else used.where(only)
    used = used.select(*KEY, "split", F.col("target_pos").alias("pos"), F.col("target_time").alias("anchor_time"), "recent")
    steps = B.future_explode(used).withColumnRenamed("pos", "anchor_pos")
    target = rows.select(*KEY, "target_pos", "target_time", "empty", "kwh", "slot", "persist")
    out = steps.join(target, [*KEY, "target_pos"]).withColumn("recent", F.coalesce("recent", "slot"))
    blend = F.round(sum(F.col(c) * w for c, w in BLEND.items()), 9)
    return out.select(*KEY, "anchor_pos", "split", "anchor_time", "step", "target_pos", "target_time", "empty", "kwh", "slot", "persist", "recent", blend.alias("blend"))


@once
def midnight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``wide`` whose anchor is at midnight: one horizon a day, a 96th of all rows."""
    return expanded(forecasts(spark, sf_dir), ("val", "test"), is_midnight("target_time"))


def long(frame: DataFrame, models: tuple[str, ...] = (*MODELS, "blend")) -> DataFrame:
    """One row for each model: (keys, model, p)."""
    ids = [c for c in frame.columns if c not in (*MODELS, "blend")]
    return frame.unpivot(ids, list(models), "model", "p")


#: The same tables as SQL common table expressions; later ones use earlier ones.
CTE = {
    "rd": f"SELECT user_id % {ENTITIES} AS entity_id, ts, event_type, value FROM events",
    "raw": """SELECT entity_id, time_bucket(INTERVAL '15 minutes', ts) AS bin_start, count(*) FILTER (event_type = 'view') AS c1,
      count(*) FILTER (event_type = 'click') AS c2, sum(value) FILTER (event_type = 'purchase') AS hvac,
      sum(value) FILTER (event_type = 'signup') AS light, avg(value) FILTER (event_type = 'error') AS sensor FROM rd GROUP BY 1, 2""",
    "spine": "SELECT entity_id, unnest(generate_series(min(bin_start), max(bin_start), INTERVAL '15 minutes')) AS bin_start FROM raw GROUP BY 1",
    "full_bins": """SELECT entity_id, bin_start, row_number() OVER (PARTITION BY entity_id ORDER BY bin_start) - 1 AS pos,
      coalesce(c1, 0) AS c1, coalesce(c2, 0) AS c2, hvac, light, sensor FROM spine LEFT JOIN raw USING (entity_id, bin_start)""",
    "cuts": "SELECT entity_id, floor(avg(c1))::BIGINT AS low_cut, floor(avg(c1) + 2.5 * stddev_samp(c1))::BIGINT AS high_cut FROM full_bins GROUP BY 1",
    "cut_bins": "SELECT b.*, CASE WHEN isodow(bin_start) <= 5 AND hour(bin_start) BETWEEN 8 AND 17 THEN low_cut ELSE high_cut END AS cut FROM full_bins b JOIN cuts USING (entity_id)",
    "bins": """SELECT *, (c1 > cut)::INTEGER AS occupied, 1 - (c1 > cut)::INTEGER AS empty,
      ((isodow(bin_start) - 1) * 96 + hour(bin_start) * 4 + minute(bin_start) // 15)::INTEGER AS slot,
      greatest(coalesce(hvac, 0) + coalesce(light, 0), 0) * 0.25 AS kwh FROM cut_bins""",
    "sizes": "SELECT entity_id, count(*) AS n FROM bins GROUP BY 1",
    "bounds": """SELECT entity_id, n, date_trunc('week', min(bin_start))::TIMESTAMP AS b1, date_trunc('week', max(bin_start))::TIMESTAMP AS b2
      FROM bins JOIN sizes USING (entity_id) WHERE pos IN (floor(n * 0.5)::BIGINT, floor(n * 0.75)::BIGINT) GROUP BY 1, 2""",
    "anchors": """SELECT * FROM (SELECT b.*, b1, b2, CASE WHEN bin_start + INTERVAL '1 day' < b1 THEN 'train'
        WHEN bin_start - INTERVAL '1425 minutes' >= b1 + INTERVAL '1 day' AND bin_start + INTERVAL '1 day' < b2 THEN 'val'
        WHEN bin_start - INTERVAL '1425 minutes' >= b2 + INTERVAL '1 day' THEN 'test' END AS split
      FROM bins b JOIN bounds USING (entity_id) WHERE pos >= 95 AND pos < n - 96) WHERE split IS NOT NULL""",
    "train": "SELECT bins.* FROM bins JOIN bounds USING (entity_id) WHERE bin_start < b1",
    "slots": "SELECT entity_id, slot, avg(empty) AS slot_mean FROM train GROUP BY 1, 2",
    "means": "SELECT entity_id, avg(empty) AS train_mean FROM train GROUP BY 1",
    "days": "SELECT b.entity_id, b.pos, avg(e.empty) AS persist FROM bins b JOIN range(1, 8) r(k) ON TRUE JOIN bins e ON e.entity_id = b.entity_id AND e.pos = b.pos - 96 * k GROUP BY 1, 2",
    "target": """SELECT b.entity_id, b.pos AS target_pos, b.bin_start AS target_time, empty, kwh, round(coalesce(slot_mean, train_mean), 9) AS slot,
      round(coalesce(persist, train_mean), 9) AS persist FROM bins b LEFT JOIN slots USING (entity_id, slot) JOIN means USING (entity_id) LEFT JOIN days USING (entity_id, pos)""",
    "recents": """SELECT entity_id, pos AS anchor_pos, CASE WHEN pos >= 96 THEN round(avg(empty) OVER (PARTITION BY entity_id ORDER BY pos ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING), 9) END AS recent FROM bins""",
    "wide_all": """SELECT a.entity_id, a.pos AS anchor_pos, a.split, a.bin_start AS anchor_time, step, t.target_pos, target_time, t.empty, t.kwh, t.slot, t.persist,
      coalesce(recent, t.slot) AS recent, round(t.slot * 0.5 + t.persist * 0.3 + coalesce(recent, t.slot) * 0.2, 9) AS blend
      FROM anchors a JOIN range(1, 97) r(step) ON TRUE JOIN target t ON t.entity_id = a.entity_id AND t.target_pos = a.pos + step
      JOIN recents rc ON rc.entity_id = a.entity_id AND rc.anchor_pos = a.pos WHERE a.split IN ('val', 'test')""",
    "wide_mid": "SELECT * FROM wide_all WHERE hour(anchor_time) = 0 AND minute(anchor_time) = 0",
    "long_all": "SELECT * FROM (UNPIVOT wide_all ON slot, persist, recent, blend INTO NAME model VALUE p)",
    "long_mid": "SELECT * FROM (UNPIVOT wide_mid ON slot, persist, recent, blend INTO NAME model VALUE p)",
    "low4": """SELECT *, CASE WHEN count(*) OVER w = 4 THEN min(p) OVER w END AS low FROM long_mid
      WINDOW w AS (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""",
    "opened": """SELECT * EXCLUDE (low), max(low) OVER (PARTITION BY entity_id, model, anchor_pos ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS opening FROM low4""",
    "grid": "SELECT k::INTEGER AS thr_idx, (k * 25 + 50) / 1000 AS threshold FROM range(37) r(k)",
    "swept": """SELECT entity_id, split, model, thr_idx, threshold, count(DISTINCT anchor_pos) AS daily_schedules, count(*) AS total_intervals,
      count(*) FILTER (rec) AS recommended_intervals, count(*) FILTER (rec AND empty = 1) AS safe_intervals, count(*) FILTER (rec AND empty = 0) AS conflict_intervals,
      count(*) FILTER (rec) / count(*) AS coverage, coalesce(count(*) FILTER (rec AND empty = 0) / nullif(count(*) FILTER (rec), 0), 0) AS conflict_rate,
      coalesce(count(*) FILTER (rec AND empty = 1) / nullif(count(*) FILTER (empty = 1), 0), 0) AS empty_recall,
      coalesce(sum(kwh) FILTER (rec), 0) AS gross_kwh, coalesce(sum(kwh) FILTER (rec AND empty = 1), 0) AS safe_kwh
      FROM (SELECT *, coalesce(opening >= threshold - 1e-11, FALSE) AS rec FROM opened JOIN grid ON TRUE) GROUP BY ALL""",
    "chosen": """SELECT * FROM (SELECT s.*, delta, (round(conflict_rate, 9) <= delta)::INTEGER AS met, row_number() OVER (PARTITION BY entity_id, model, delta ORDER BY
        (round(conflict_rate, 9) <= delta)::INTEGER DESC, CASE WHEN round(conflict_rate, 9) <= delta THEN -round(safe_kwh, 6) ELSE round(conflict_rate, 9) END,
        CASE WHEN round(conflict_rate, 9) <= delta THEN -round(empty_recall, 9) ELSE -round(safe_kwh, 6) END, thr_idx) AS rk
      FROM swept s JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) d(delta) ON TRUE WHERE split = 'val') WHERE rk = 1""",
    "masked": """SELECT o.*, c.delta, c.met, c.thr_idx, c.threshold, coalesce(opening >= c.threshold - 1e-11, FALSE) AS rec FROM opened o JOIN chosen c USING (entity_id, model) WHERE o.split = 'test'""",
    "islands": """SELECT *, step - row_number() OVER (PARTITION BY entity_id, model, delta, anchor_pos ORDER BY step) AS island FROM masked WHERE rec""",
    "runs": "SELECT entity_id, model, delta, anchor_pos, island, min(step) AS start_step, max(step) + 1 AS end_step_excl, count(*) AS length, min(empty) AS safe FROM islands GROUP BY ALL",
}
USES = {
    "rd": (), "raw": ("rd",), "spine": ("raw",), "full_bins": ("spine", "raw"), "cuts": ("full_bins",), "cut_bins": ("full_bins", "cuts"), "bins": ("cut_bins",), "sizes": ("bins",), "bounds": ("sizes",),
    "anchors": ("bounds",), "train": ("bounds",), "slots": ("train",), "means": ("train",), "days": ("bins",), "target": ("slots", "means", "days"), "recents": ("bins",),
    "wide_all": ("anchors", "target", "recents"), "wide_mid": ("wide_all",), "long_all": ("wide_all",), "long_mid": ("wide_mid",), "low4": ("long_mid",), "opened": ("low4",),
    "grid": (), "swept": ("opened", "grid"), "chosen": ("swept",), "masked": ("opened", "chosen"), "islands": ("masked",), "runs": ("islands",),
}


def sql(query: str, *names: str) -> str:
    """``query`` behind the expressions that ``names`` need."""
    need: list[str] = []

    def add(n: str) -> None:
        for u in USES[n]:
            add(u)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in need) + "\n" + query if need else query
