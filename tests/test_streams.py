"""Windows from a stream, quota samples, exports that stop: against plain forms."""

import datetime as dt
import random
from tempfile import mkdtemp

import pytest
from pyspark.sql import functions as F

from tidemill.operators import checks as C
from tidemill.operators import features as L
from tidemill.operators import windows as W
from tidemill.sources.scratch import fresh_path
from tidemill.streaming.runs import STORE, late_rows, stream_windows


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield
    spark.conf.set(STORE[0], before)


SCHEMA = "e string, day int, target_time timestamp, step int, rec boolean, empty int"


def drain(spark, place, rows, late, least=1):
    """Adds rows to the stream and runs it as far as they go; rows dropped."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = stream_windows(spark.readStream.schema(SCHEMA).parquet(f"{place}/in"), ["e", "day"], late=late, least=least)
    q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return late_rows(q)


@pytest.mark.parametrize("least", [1, 3])
def test_windows_of_a_stream_are_those_of_the_table(spark, store, least):
    rng = random.Random(least)
    start = dt.datetime(2024, 5, 1)
    rows = [(e, day, start + dt.timedelta(days=day, minutes=15 * step), step, rng.random() < 0.7, rng.randint(0, 3) and 1) for e in "ab" for day in range(3) for step in range(1, 97) if rng.random() < 0.95]
    rows.append(("z", 9, start + dt.timedelta(days=9, minutes=15), 1, False, 1))  # moves the clock past all others
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randint(0, 119)))  # no row comes two hours late
    place = mkdtemp(prefix="spark-")
    dropped = sum(drain(spark, place, rows[at : at + 150], "2 hours", least) for at in range(0, len(rows), 150))
    table = spark.createDataFrame(rows, SCHEMA)
    want = W.extract_windows(table, ["e", "day"], least=least, extra={"safe": F.min("empty").alias("safe")})
    cols = ["e", "day", "start_step", "end_step_excl", "length", "safe"]
    assert dropped == 0
    assert sorted(map(tuple, spark.read.parquet(f"{place}/out").select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_late_steps_are_dropped_and_counted(spark, store):
    start, place = dt.datetime(2024, 5, 1), mkdtemp(prefix="spark-")
    row = lambda step, rec=True: ("a", 0, start + dt.timedelta(minutes=15 * step), step, rec, 1)
    assert drain(spark, place, [row(1), row(2), row(4), row(20, False)], "1 hour") == 0
    assert drain(spark, place, [row(3), row(16), row(17), row(19)], "1 hour") == 2  # 3 and 16 are no later than 20 less an hour
    assert drain(spark, place, [row(96, False), ("b", 1, start + dt.timedelta(days=4), 1, False, 1)], "1 hour") == 0
    got = sorted((r.start_step, r.end_step_excl, r.length) for r in spark.read.parquet(f"{place}/out").collect())
    assert got == [(1, 3, 2), (4, 5, 1), (17, 18, 1), (19, 20, 1)]


def sampled(rows, quota):
    pos, neg = ([r for r in rows if r[1] == y] for y in (1, 0))
    n = min(len(pos), quota // 2)
    m = min(len(neg), quota - n)
    return sorted(pos)[: min(len(pos), quota - m)] + sorted(neg)[:m]


@pytest.mark.parametrize("quota", [1, 5, 10, 60])
def test_quota_sample_of_each_key(spark, quota):
    rng = random.Random(quota)
    rows = [(i, int(rng.random() < share), e) for e, share in (("a", 0.1), ("b", 0.9), ("c", 0.0), ("d", 1.0)) for i in range(25)]
    df = spark.createDataFrame(rows, "i int, y int, e string").repartition(5)
    got = L.stratified_sample(df, "y", quota, ["i"], ["e"])
    want = [r for e in "abcd" for r in sampled([r for r in rows if r[2] == e], quota)]
    assert sorted(map(tuple, got.select("i", "y", "e").collect())) == sorted(want)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()  # tasks keep a quota each before the shuffle


def test_exports_stop_on_gaps_and_repeats(spark):
    rows, path = spark.range(100).selectExpr("id as k", "id * 2 as v"), fresh_path(spark, "export")
    write = lambda df, p: df.write.parquet(p)
    lookup = lambda first: spark.range(first, 200).selectExpr("id as k", "id + 0.5 as kwh")
    assert C.matched_export(rows, lookup(1), ["k"], write, path) == {"targets": 100, "unmatched": 1, "duplicate_keys": 0}
    back = spark.read.parquet(path)
    assert back.columns == ["k", "v", "kwh"] and back.count() == 100 and back.where("kwh is null").count() == 1
    for bad, said in ((lookup(2), "2 of 100"), (lookup(0).unionByName(lookup(199)), "no match"), (lookup(0).unionByName(lookup(7).limit(1)), "repeated")):
        path = fresh_path(spark, "export")
        if said == "no match":  # the repeated key meets no row
            assert C.matched_export(rows, bad, ["k"], write, path)["duplicate_keys"] == 0
            continue
        with pytest.raises(ValueError, match=said):
            C.matched_export(rows, bad, ["k"], write, path)
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            spark.read.parquet(path)
