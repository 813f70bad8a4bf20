"""Queries: exports and what is read back from them, and bins from a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.scalar import bin_bounds
from tidemill.operators.checks import matched_export
from tidemill.plans import base
from tidemill.plans.base import KEY, sql
from tidemill.plans.decide import masked, midnight
from tidemill.plans.registry import query
from tidemill.sources import sensors
from tidemill.sources.scratch import fresh_path as folder
from tidemill.streaming.bins import closed_bins
from tidemill.streaming.runs import STORE, late_rows, stream_windows


@query("read_sensor_csv", "SELECT event_id, ts AS date, value FROM events WHERE event_id % 7 <> 0", "value")
def _(spark, d):
    path = folder(spark, "csv")
    e = spark.read.parquet(f"{d}/events.parquet")
    bad = F.col("event_id") % 7 == 0  # rows with a time that can't be read must go
    e.select(F.when(bad, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("stamp"), "event_id", "value").write.option("header", True).csv(path)
    return sensors.read_sensor_csv(spark, path, ["event_id", "value"]).withColumn("event_id", F.col("event_id").cast("long"))


BOUNDS = {"bin_start": "anchor_time", "bin_end": "anchor_time + INTERVAL '15 minutes'", "issue_time": "anchor_time + INTERVAL '15 minutes'", "target_start": "anchor_time + step * INTERVAL '15 minutes'", "target_end": "anchor_time + (step + 1) * INTERVAL '15 minutes'"}
SCORES = [f"{m}_{side}" for m in base.MODELS for side in ("empty", "occupied")]
EXPORT = f"SELECT entity_id, split, anchor_pos, step::INTEGER AS step, empty, 1 - empty AS occupied, {', '.join(f'{e} AS {n}' for n, e in BOUNDS.items())}, {', '.join(f'{m} AS {m}_empty, 1 - {m} AS {m}_occupied' for m in base.MODELS)} FROM wide_mid"


@query("write_forecast_export", sql(EXPORT, "wide_mid"), " ".join(SCORES))
def _(spark, d):
    path = folder(spark, "export")
    w = base.wide(spark, d, midnight=True)
    bounds = {"bin_start": F.col("anchor_time")} | bin_bounds("anchor_time", "step")
    scores = [c.alias(f"{m}_{side}") for m in base.MODELS for side, c in (("empty", F.col(m)), ("occupied", 1 - F.col(m)))]
    out = w.select(*KEY, "split", "anchor_pos", "step", "empty", (1 - F.col("empty")).alias("occupied"), *(bounds[n].alias(n) for n in BOUNDS), *scores)
    out.write.partitionBy("split").parquet(path)
    return sensors.read_scores(spark, path, out.schema)


@query("write_per_model_export", sql("SELECT entity_id, split, anchor_pos, model, (15 * step)::INTEGER AS horizon_minutes, p AS p_empty, 1 - p AS p_occupied FROM long_mid", "long_mid"), "p_empty p_occupied")
def _(spark, d):
    path = folder(spark, "models")
    out = midnight(spark, d).select(*KEY, "split", "anchor_pos", "model", (15 * F.col("step")).alias("horizon_minutes"), F.col("p").alias("p_empty"), (1 - F.col("p")).alias("p_occupied"))
    out.write.partitionBy("model", "split").parquet(path)
    return sensors.read_scores(spark, path, out.schema)


@query("read_saved_scores", sql("SELECT entity_id, model, count(*) AS rows, avg(p) AS mean_p FROM long_mid GROUP BY 1, 2", "long_mid"), "mean_p")
def _(spark, d):
    path = folder(spark, "saved") + ".csv"
    out = midnight(spark, d).select(*KEY, "model", "p")
    out.write.option("header", True).csv(path)
    return sensors.read_scores(spark, path, out.schema).groupBy(*KEY, "model").agg(F.count("*").alias("rows"), F.avg("p").alias("mean_p"))


@query("write_blend_export", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, blend, 0.5::DOUBLE AS w_slot, 0.3::DOUBLE AS w_persist, 0.2::DOUBLE AS w_recent FROM wide_mid", "wide_mid"), "blend")
def _(spark, d):
    path = folder(spark, "blend")
    out = base.wide(spark, d, midnight=True).select(*KEY, "anchor_pos", "step", "blend", *(F.lit(w).alias(f"w_{m}") for m, w in base.BLEND.items()))
    out.write.parquet(path)
    return sensors.read_scores(spark, path, out.schema)


MICRO = "string_agg((floor({m} * 1e6 + 0.5))::BIGINT::VARCHAR, ',' ORDER BY step) AS {m}_millionths"
PAYLOAD = f"SELECT entity_id, anchor_pos, min(target_time) AS first_target, max(target_time) AS last_target, string_agg(empty::VARCHAR, ',' ORDER BY step) AS empties, count(*) AS steps, sum(kwh) AS kwh, {', '.join(MICRO.format(m=m) for m in base.MODELS)} FROM wide_mid GROUP BY 1, 2"


@query("horizon_payload", sql(PAYLOAD, "wide_mid"), "kwh")
def _(spark, d):
    """One nested record for each horizon, written as JSON and read back: times, labels and loads in order, and a map of scores."""
    path, models = folder(spark, "payload"), base.MODELS
    step = F.struct("step", "target_time", "empty", "kwh", *models)
    rows = base.wide(spark, d, midnight=True).groupBy(*KEY, "anchor_pos").agg(F.array_sort(F.collect_list(step)).alias("s"))  # 96 in each
    scores = F.map_from_arrays(F.array(*(F.lit(m) for m in models)), F.array(*(F.col(f"s.{m}") for m in models)))
    nested = rows.select(*KEY, "anchor_pos", F.col("s.target_time").alias("target_times"), F.col("s.empty").alias("empty"), F.col("s.kwh").alias("load_kwh"), scores.alias("scores"))
    nested.write.json(path)
    back = spark.read.schema(nested.schema).json(path)
    millionths = lambda m: F.array_join(F.transform(F.col("scores")[m], lambda p: F.floor(p * 1e6 + 0.5).cast("string")), ",")
    return back.select(
        *KEY, "anchor_pos", F.array_min("target_times").alias("first_target"), F.array_max("target_times").alias("last_target"),
        F.array_join(F.transform("empty", lambda e: e.cast("string")), ",").alias("empties"), F.size("empty").cast("long").alias("steps"),
        F.aggregate("load_kwh", F.lit(0.0), lambda a, x: a + x).alias("kwh"), *(millionths(m).alias(f"{m}_millionths") for m in models),
    )


@query("sample_output_csv", sql("SELECT entity_id, anchor_pos, step::INTEGER AS step, p, empty, kwh, CASE WHEN opening >= 0.8 - 1e-11 THEN CASE empty WHEN 1 THEN 'safe' ELSE 'conflict' END ELSE 'none' END AS state FROM opened WHERE model = 'blend'", "opened"), "p kwh")
def _(spark, d):
    from tidemill.operators.windows import stable_mask

    path = folder(spark, "sample")
    m = stable_mask(midnight(spark, d, models=("blend",)), ["entity_id", "model", "anchor_pos"], 0.8 - 1e-11)
    out = m.select(*KEY, "anchor_pos", "step", "p", "empty", "kwh", F.when(~F.col("rec"), "none").when(F.col("empty") == 1, "safe").otherwise("conflict").alias("state"))
    out.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(out.schema).csv(path)


#: Bins over by the time of the last reading less the hour that late rows are waited for.
CLOSED = "SELECT user_id % 2 AS entity_id, time_bucket(INTERVAL '15 minutes', ts) AS bin_start, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2 HAVING bin_start + INTERVAL '15 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"


@query("stream_closed_bins", CLOSED, "mean")
def _(spark, d):
    """Bins of ``events`` as a stream emits them once the watermark has passed their end."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    rows = stream.select((F.col("user_id") % base.ENTITIES).alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    path = folder(spark, "stream")
    q = closed_bins(rows, KEY).writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "progress")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).withColumn("bin_start", F.col("bin_start").cast("timestamp_ntz"))


#: What each lookup lacks: nothing; what the loads lack; nothing, but some bins are there twice.
LOOKUPS = """all_bins AS (SELECT entity_id, pos, 1 AS n FROM bins), loads AS (SELECT entity_id, pos, 1 AS n FROM bins WHERE hvac IS NOT NULL OR light IS NOT NULL),
twice AS (SELECT entity_id, pos, CASE WHEN pos % 50 = 0 THEN 2 ELSE 1 END AS n FROM bins)"""
CHECKED = " UNION ALL ".join(
    f"SELECT '{t}' AS lookup, (count(*) FILTER (l.n IS NULL) <= 0.01 * count(*) AND count(*) FILTER (l.n > 1) = 0)::INTEGER AS exported, CASE WHEN count(*) FILTER (l.n IS NULL) <= 0.01 * count(*) AND count(*) FILTER (l.n > 1) = 0 THEN count(*) ELSE 0 END AS written FROM wide_mid w LEFT JOIN {t} l ON l.entity_id = w.entity_id AND l.pos = w.target_pos"
    for t in ("all_bins", "loads", "twice")
)


@query("checked_export", sql("", "wide_mid").rstrip() + f", {LOOKUPS}\n" + CHECKED)
def _(spark, d):
    """Exports of targets with their loads that stop, and leave nothing, when rows lack a match or meet a repeated bin."""
    bins = base.bins(spark, d).select(*KEY, F.col("pos").alias("target_pos"), "hvac", "light")
    lookups = {"all_bins": bins, "loads": bins.where("hvac is not null or light is not null"), "twice": bins.unionByName(bins.where("target_pos % 50 = 0"))}
    out = []
    for name, lookup in lookups.items():
        path = folder(spark, "checked")
        try:
            matched_export(base.wide(spark, d, midnight=True), lookup, [*KEY, "target_pos"], lambda df, p: df.write.parquet(p), path)
            out.append((name, 1, spark.read.parquet(path).count()))
        except ValueError:
            out.append((name, 0, 0))
    return spark.createDataFrame(out, "lookup string, exported int, written long")


HORIZON = [*KEY, "model", "anchor_pos"]


def _streamed(spark, rows, late):
    """Windows of rows that arrive one table after another, and how many rows the stream reports as dropped."""
    source, path, progress = folder(spark, "steps"), folder(spark, "stream"), folder(spark, "progress")
    before, dropped = spark.conf.get(STORE[0]), 0
    spark.conf.set(*STORE)
    try:
        for part in rows:
            picked = part.select(*HORIZON, F.col("target_time").cast("timestamp").alias("target_time"), "step", "rec", "empty")
            picked.write.mode("append").parquet(source)
            stream = spark.readStream.schema(picked.schema).parquet(source)
            q = stream_windows(stream, HORIZON, late=late).writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
            q.awaitTermination()
            dropped += late_rows(q)
    finally:
        spark.conf.set(STORE[0], before)
    return spark.read.parquet(path), dropped


#: Windows whose end is certain an hour before the last step.
SURE = """SELECT entity_id, model, anchor_pos, start_step::INTEGER AS start_step, end_step_excl::INTEGER AS end_step_excl, length::INTEGER AS length, safe::INTEGER AS safe FROM runs r
  JOIN (SELECT DISTINCT entity_id, anchor_pos, anchor_time FROM masked) a USING (entity_id, anchor_pos)
  WHERE delta = 0.1 AND anchor_time + least(end_step_excl, 96) * INTERVAL '15 minutes' <= (SELECT max(target_time) FROM masked) - INTERVAL '1 hour'"""


@query("stream_run_windows", sql(SURE, "runs"))
def _(spark, d):
    """Windows of the policies selected at 10 %, found in a stream of steps."""
    return _streamed(spark, [masked(spark, d).where("delta = 0.1")], "1 hour")[0]


@query("stream_late_rows", sql("SELECT count(*) AS late FROM masked WHERE delta = 0.1 AND step % 7 = 0 AND target_time <= (SELECT max(target_time) FROM masked) - INTERVAL '1 hour'", "masked"))
def _(spark, d):
    """Steps that come once more when the stream is past them: how many it reports as dropped."""
    rows = masked(spark, d).where("delta = 0.1")
    _, dropped = _streamed(spark, [rows, rows.where("step % 7 = 0")], "1 hour")
    return spark.createDataFrame([(dropped,)], "late long")
