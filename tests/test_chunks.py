"""As-of joins and windows over chunks, against the plain forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import bins as B
from tidemill.operators import features as L
from tidemill.operators.chunks import asof_join

START = dt.datetime(2024, 3, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def slow(left, right, within=None, exact=True):
    out = []
    for k, t, i in left:
        seen = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] <= t if exact else r[1] < t)]
        best = max(seen, key=lambda r: (r[1], r[2]), default=None)
        if best is not None and within is not None and best[1] < t - within:
            best = None
        out.append((k, t, i, best and best[2], best and best[1]))
    return sorted(out, key=str)


def sides(n, seed):
    rnd = random.Random(seed)
    key = lambda: rnd.choice(["a", "a", "a", "b", "c", None])
    time = lambda: rnd.choice([rnd.randint(0, 5000), rnd.randint(0, 40) * 100, rnd.randint(90_000, 90_100), None])
    return [(key(), time(), i) for i in range(n)] + [("only left", 5, n)], [(key(), time(), i) for i in range(n // 2)] + [("only right", 5, 0)]


@pytest.mark.parametrize("chunk", [1, 60, 3600, 10**9])
@pytest.mark.parametrize("exact, within", [(True, None), (False, None), (True, 45)])
def test_asof_join(spark, chunk, exact, within):
    left, right = sides(150, chunk)
    frame = lambda rows: spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "k string, ts timestamp_ntz, i int")
    reading = frame(right).withColumnRenamed("ts", "heard").withColumnRenamed("i", "value")
    got = asof_join(frame(left), reading, ["k"], {"value": "v"}, right_time="heard", matched="from", tie=["value"], within=within and f"{within} seconds", exact=exact, chunk=chunk)
    assert got.columns == ["k", "ts", "i", "v", "from"]
    want = [(k, at(t), i, v, at(f)) for k, t, i, v, f in slow(left, right, within, exact)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_asof_join_of_nothing(spark):
    left = spark.createDataFrame([("a", at(5))], "k string, ts timestamp_ntz")
    none = spark.createDataFrame([], "k string, ts timestamp_ntz, v double")
    assert asof_join(left, none, ["k"], {"v": "v"}).first().v is None
    assert asof_join(left.where("false"), none, ["k"], {"v": "v"}).count() == 0


def test_asof_join_has_no_join_of_all_pairs(spark):
    left, right = sides(20, 1)
    frame = lambda rows: spark.createDataFrame([(k, at(t), i) for k, t, i in rows], "k string, ts timestamp_ntz, i int")
    text = asof_join(frame(left), frame(right), ["k"], {"i": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text


@pytest.mark.parametrize("chunk", [1, 7, 96, 10**6])
def test_windows_over_chunks(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(e, p, rnd.choice([None, *range(9)])) for e in "xy" for p in range(230 if e == "x" else 3)]
    df = spark.createDataFrame(rows, "e string, pos long, v int")
    w = Window.partitionBy("e").orderBy("pos")
    plain = df.withColumns({f"v_lag_{k}": F.lag("v", k).over(w) for k in (1, 96)})
    plain = plain.withColumns({f"v_mean_{k}": F.when(F.col("pos") >= k, F.avg("v").over(w.rowsBetween(-k, -1))) for k in (4, 30)})
    plain = plain.withColumn("history", F.collect_list("v").over(w.rowsBetween(-9, 0)))
    got = L.rolling_means(L.lags(df, "v", (1, 96), ["e"], chunk), "v", (4, 30), ["e"], chunk)
    got = B.history_window(got, "v", ["e"], 10, chunk).select(*plain.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
