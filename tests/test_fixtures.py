"""Cases of the operators, worked out by hand or by plain loops."""

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scalar as S
from tidemill.operators import bins as B
from tidemill.operators import checks as C
from tidemill.operators import metrics as M
from tidemill.operators import policy as P
from tidemill.operators import windows as W


def steps(spark, p, empty=None, kwh=None, day=0):
    rows = [(day, i + 1, float(x), (empty or [1] * len(p))[i], float((kwh or [1] * len(p))[i])) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "day int, step int, p double, empty int, kwh double")


def mask(spark, df, cut, length):
    return [r.rec for r in W.stable_mask(df, ["day"], cut, length).orderBy("day", "step").collect()]


def test_stable_mask(spark):
    low = steps(spark, [0.31, 0.62, 0.64, 0.6, 0.59, 0.9, 0.9])
    assert mask(spark, low, 0.6, 3) == [False, True, True, True, False, False, False]  # a score at the cut counts, a run of two doesn't
    assert mask(spark, low, 0.6, 2) == [False, True, True, True, False, True, True]
    evening_and_morning = steps(spark, [0.1, 0.7, 0.7]).unionByName(steps(spark, [0.7, 0.1, 0.1], day=1))
    assert not any(mask(spark, evening_and_morning, 0.5, 3))  # days don't join


def test_stable_mask_of_random_scores(spark):
    rng = random.Random(11)
    p = [round(rng.random(), 1) for _ in range(80)]
    for length in (1, 2, 5):
        want = [any(0 <= a and a + length <= 80 and min(p[a : a + length]) >= 0.4 for a in range(i - length + 1, i + 1)) for i in range(80)]
        assert mask(spark, steps(spark, p), 0.4, length) == want


def test_windows_and_severity(spark):
    #      step 1  2  3  4  5  6  7  8  9 10 11
    empty = [1, 1, 0, 0, 1, 1, 1, 1, 0, 1, 1]
    df = steps(spark, [0] * 11, empty).withColumn("rec", ~F.col("step").isin(3, 8, 11))  # windows 1-2, 4-7, 9-10
    r = W.window_summary(df, ["day"], ["day"]).first()
    assert (r.recommended_windows, r.safe_windows, r.conflict_windows, r.total_window_hours, r.avg_safe_window_hours) == (3, 1, 2, 2.0, 0.5)
    long = steps(spark, [0] * 9, [0, 1, 1, 1, 1, 0, 0, 1, 1], [0.5, 1, 1, 1, 1, 2, 0.25, 1, 1]).withColumn("rec", F.lit(True))
    s = W.conflict_severity(long, ["day"]).first()
    assert (s.occupied_intervals, s.occupied_minutes, s.longest_minutes, s.conflict_kwh, round(s.percent_occupied, 6)) == (3, 45, 30, 2.75, 33.333333)
    assert (s.conflict_begin, s.conflict_middle, s.conflict_end, s.occupied_steps) == (1, 1, 1, "1|6|7")
    late = steps(spark, [0] * 6, [1, 1, 1, 1, 1, 0]).withColumn("rec", F.lit(True))
    s = W.conflict_severity(late, ["day"]).first()
    assert (s.conflict_begin, s.conflict_middle, s.conflict_end, s.occupied_steps, s.longest_minutes) == (0, 0, 1, "6", 15)


def test_policy_row(spark):
    seven = steps(spark, [0.5, 0.7, 0.72, 0.71, 0.2, 0.9, 0.95], [1, 0, 1, 1, 1, 1, 0], [1, 2, 4, 8, 16, 32, 64])
    df = W.stable_mask(seven, ["day"], 0.7, 2).withColumn("g", F.lit(1))  # steps 2-4 and 6-7
    r = M.policy_rows(df, ["g"], ["day"]).first()
    assert (r.recommended_intervals, r.safe_intervals, r.conflict_intervals, r.conflict_rate, r.empty_recall) == (5, 3, 2, 0.4, 0.6)
    assert (r.gross_kwh, r.safe_kwh, r.conflict_kwh, r.kwh_per_day) == (110.0, 44.0, 66.0, 44.0)
    assert M.policy_rows(df.where("false"), ["g"], ["day"]).count() == 0
    idle = M.policy_rows(df.withColumn("rec", F.lit(False)), ["g"], ["day"]).first()
    assert (idle.recommended_intervals, idle.conflict_rate, idle.safe_kwh) == (0, 0.0, 0.0)


def test_bins(spark):
    raw = spark.createDataFrame([(1, "02:15:00", 5.0), (1, "02:29:59", 7.5), (1, "02:30:00", 1.0), (2, "02:15:00", None)], "k int, t string, value double")
    raw = raw.select("k", F.expr("to_timestamp_ntz(concat('2024-06-02 ', t))").alias("ts"), "value")
    got = sorted((r.k, str(r.bin_start)[11:16], r.value) for r in B.resample_mean(raw, ["k"]).collect())
    assert got == [(1, "02:15", 6.25), (1, "02:30", 1.0), (2, "02:15", None)]
    gaps = spark.createDataFrame([(1, i, s, i) for i, s in enumerate([None, None, 4.5, None, 2.0])], "k int, pos int, s double, y int")
    assert [(r.s, r.y) for r in B.forward_fill(gaps, ["s"], ["k"]).orderBy("pos").collect()] == [(0.0, 0), (0.0, 1), (4.5, 2), (4.5, 3), (2.0, 4)]


def test_chunked_fill_equals_plain(spark):
    rows = [(k, i, None if (i * 7 + k) % 5 else float(i)) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, pos int, s double")
    show = lambda x: sorted(map(tuple, x.select("k", "pos", "s").collect()))
    assert show(B.forward_fill(df, ["s"], ["k"])) == show(B.forward_fill_chunked(df, ["s"], ["k"], chunk=8))


def test_scalars(spark):
    df = spark.createDataFrame([(6.0, None), (-1.5, 0.5), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(S.interval_kwh("a")).collect()] == [1.5, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(S.row_sum_min1("a", "b")).collect()] == [6.0, -1.0, 3.0, None]
    assert [r[0] for r in df.select(S.row_mean_skipna("a", "b")).collect()] == [6.0, -0.5, 3.0, None]
    for bad in ({"a": 0.7, "b": 0.2}, {"a": 1.25, "b": -0.25}):
        with pytest.raises(ValueError):
            S.convex_blend(bad)


def test_holidays_by_rule(spark):
    """The days of three years by the calendar module: fixed dates as observed, and the nth weekday of a month."""
    days = {str(r.day) for r in S.us_holidays(spark, 2021, 2023).collect()}
    for year in (2021, 2022, 2023):
        nth = lambda month, weekday, n: [d for d in calendar.Calendar().itermonthdates(year, month) if d.month == month and d.weekday() == weekday][n]  # noqa: B023, E731
        moved = lambda d: d + dt.timedelta({5: -1, 6: 1}.get(d.weekday(), 0))  # noqa: E731  from a weekend to the day beside it
        fixed = {str(moved(dt.date(year, *d))) for d in ((7, 4), (11, 11), (12, 25))}
        assert fixed | {str(nth(1, 0, 2)), str(nth(5, 0, -1)), str(nth(9, 0, 0)), str(nth(11, 3, 3))} <= days


def test_simplex(spark):
    for step, parts in ((0.25, 4), (0.1, 10), (0.05, 20)):
        rows = sorted(P.simplex_grid(spark, P.step_parts(step)).collect(), key=lambda r: r.grid_order)
        want = [(i, j, parts - i - j) for i in range(parts + 1) for j in range(parts + 1 - i)]
        assert [tuple(round(w * parts) for w in (r.w1, r.w2, r.w3)) for r in rows] == want and [r.grid_order for r in rows] == list(range(len(want)))
        assert all(abs(r.w1 + r.w2 + r.w3 - 1) < 1e-12 for r in rows)
    with pytest.raises(ValueError):
        P.step_parts(0.15)


def test_select_constrained(spark):
    """Against sorting in Python, over few values so that ties abound."""
    rng = random.Random(5)
    rows = [(m, i, rng.choice([0.0, 0.05, 0.1, 0.15, 0.3]), rng.choice([1.0, 2.0, 4.0]), rng.choice([0.25, 0.5])) for m in range(40) for i in rng.sample(range(37), 5)]
    rows += [(99, 3, 0.5, 9.0, 0.5), (99, 1, 0.4, 1.0, 0.5), (99, 2, 0.4, 2.0, 0.5)]  # nothing is within the limit
    df = spark.createDataFrame(rows, "model int, thr_idx int, conflict_rate double, safe_kwh double, empty_recall double")
    got = {r.model: r.thr_idx for r in P.select_constrained(df.repartition(4), ["model"], (0.1,)).collect()}
    for m in got:
        mine = [r for r in rows if r[0] == m]
        within = [r for r in mine if r[2] <= 0.1]
        best = min(within, key=lambda r: (-r[3], -r[4], r[1])) if within else min(mine, key=lambda r: (r[2], -r[3], r[1]))
        assert got[m] == best[1]
    assert len(got) == 41 and got[99] == 2


def test_selection_refuses_test_columns(spark):
    with pytest.raises(ValueError):
        P.guard_selection(spark.createDataFrame([(1,)], "test_kwh int"))


def test_average_precision_and_auc(spark):
    rng = random.Random(8)
    rows = [(rng.choice([0.1, 0.2, 0.35, 0.5, 0.8]), rng.randint(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "p double, empty int").withColumn("g", F.lit(1))
    gained, found = 0.0, 0
    for cut in (0.8, 0.5, 0.35, 0.2, 0.1):
        hits, above = sum(y for p, y in rows if p >= cut), sum(p >= cut for p, _ in rows)
        gained, found = gained + (hits - found) * hits / above, hits
    assert M.average_precision(df, ["g"]).first().average_precision == pytest.approx(gained / found)
    pairs = [(a > b) + (a == b) / 2 for a, y in rows if y for b, z in rows if not z]
    assert M.auroc(df, ["g"]).first().auroc == pytest.approx(sum(pairs) / len(pairs))


def test_checks(spark):
    rows = [(3, "m", 40, s, 40 + s, s % 2, s / 100) for s in range(1, 97)]
    schema = "entity_id int, model string, anchor_pos int, step int, target_pos int, empty int, p double"
    C.require(C.validate_forecast(spark.createDataFrame(rows, schema)))
    rows[6] = (3, "m", 40, 7, 48, 1, 0.07)
    with pytest.raises(ValueError, match="target_follows_anchor"):
        C.require(C.validate_forecast(spark.createDataFrame(rows, schema)))
