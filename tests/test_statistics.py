"""Draws, running sums, quantiles, windows at all thresholds, checks: against brute force on made-up rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemill.operators import checks as C
from tidemill.operators import features as L
from tidemill.operators import metrics as M
from tidemill.operators import policy as P
from tidemill.operators import uncertainty as U
from tidemill.operators import windows as W


def test_draws_are_like_sampling_with_replacement(spark):
    blocks, reps = 20, 2000
    rows = U.draws(spark.range(blocks).selectExpr("'e' as e", "id as block_no"), reps, keys=["e"]).collect()
    mult = {}
    for r in rows:
        mult.setdefault(r.rep, [0] * blocks)[r.block_no] += r.mult
    assert len(mult) == reps and all(sum(m) == blocks for m in mult.values())
    assert len({tuple(m) for m in mult.values()}) >= 0.95 * reps
    spread = statistics.pvariance([x for m in mult.values() for x in m])
    assert spread == pytest.approx(1 - 1 / blocks, rel=0.05)  # that of a multinomial count
    means = [sum(i * x for i, x in enumerate(m)) / blocks for m in mult.values()]
    assert statistics.pstdev(means) == pytest.approx(statistics.pstdev(range(blocks)) / blocks**0.5, rel=0.05)


def test_draws_differ_between_keys_and_seeds(spark):
    two = spark.createDataFrame([(e, b) for e in "ab" for b in range(9)], "e string, block_no long")
    show = lambda df, e: sorted((r.rep, r.block_no, r.mult) for r in df.where(F.col("e") == e).collect())
    one, other = U.draws(two, 20, keys=["e"]), U.draws(two, 20, seed=7, keys=["e"])
    assert show(one, "a") != show(one, "b") and show(one, "a") != show(other, "a") and show(one, "a") == show(U.draws(two, 20, keys=["e"]), "a")


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.0, 1.0, 0.25, round(rng.random(), 3), rng.random()]), rng.randint(0, 1), i // 7, i % 7) for g in "xy" for i in range(400)]
    return rows, spark.createDataFrame(rows, "g string, p double, empty int, anchor_pos int, step int")


def test_running_sums_across_parts(scored):
    rows, df = scored
    by = df.groupBy("g", "p").agg(F.count("*").alias("n"))
    for down in (True, False):
        got = {(r.g, r.p): r.upto for r in M.running_sums(by, ["g"], "p", {"upto": "n"}, down).collect()}
        assert got == {(g, p): sum(h == g and (q >= p if down else q <= p) for h, q, *_ in rows) for g, p, *_ in rows}


def test_rank_bins_with_ties_over_chunks(scored):
    rows, df = scored
    got = {(r.g, r.bin): (r.n, round(r.observed, 9)) for r in M.rank_bins(df, ["g"], ["anchor_pos", "step"], chunk=5).collect()}
    want = {}
    for g in "xy":
        mine = sorted((p, a, s, y) for h, p, y, a, s in rows if h == g)
        for i, (*_, y) in enumerate(mine):
            want.setdefault((g, max(-(-i * 10 // (len(mine) - 1)) - 1, 0)), []).append(y)
    assert got == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}


def test_quantiles_interpolate(scored):
    rows, df = scored
    for r in M.quantiles(df, ["g"], "p", [0.1, 0.5, 0.975]).collect():
        mine = sorted(p for g, p, *_ in rows if g == r.g)
        for q, cut in zip((0.1, 0.5, 0.975), r.cuts):
            at = q * (len(mine) - 1)
            lo = int(at)
            assert cut == pytest.approx(mine[lo] + (mine[min(lo + 1, len(mine) - 1)] - mine[lo]) * (at - lo))


@pytest.mark.parametrize("length", [1, 3, 4])
def test_windows_at_all_thresholds(spark, length):
    rng = random.Random(length)
    rows = [(day, step, rng.choice([0.0, 0.3, 0.5, 0.8, 0.81, 1.0]), rng.choice([0, 1, 1, 1]), 1.0) for day in range(8) for step in range(1, 25)]
    df = W.opening(spark.createDataFrame(rows, "anchor_pos int, step int, p double, empty int, kwh double"), ["anchor_pos"], length)
    got = {r.thr_idx: (r.recommended_windows, r.safe_windows) for r in P.window_sweep(df.withColumn("g", F.lit(1)), ["g"], ["g", "anchor_pos"]).collect()}
    for k in range(37):
        runs = []
        for day in range(8):
            run = []
            for _, _, p, y, _ in [r for r in rows if r[0] == day] + [(day, 99, -1.0, 1, 0)]:
                if p >= (k * 25 + 50) / 1000:
                    run.append(y)
                elif run:
                    runs += [run] if len(run) >= length else []
                    run = []
        assert got[k] == (len(runs), sum(all(r) for r in runs))


def slow_precision(rows):
    """Average precision of (score, label, weight), one pass over distinct scores."""
    tp = fp = gained = 0.0
    for score in sorted({r[0] for r in rows}, reverse=True):
        own = sum(w * y for s, y, w in rows if s == score)
        tp, fp = tp + own, fp + sum(w * (1 - y) for s, y, w in rows if s == score)
        gained += own * tp / (tp + fp) if tp + fp else 0
    return gained / tp if tp else 0.0


@pytest.mark.parametrize("batch, ranges, reps", [(10_000, 256, 7), (3, 2, 7), (10, 1, None), (10_000, 256, None)])
def test_precision_of_replicates(spark, scored, monkeypatch, batch, ranges, reps):
    monkeypatch.setattr(U, "RANGES", ranges)
    rows, df = scored
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sums = U.score_sums(df, ["g", "anchor_pos"])
        got = {(r.g, r.rep): r.average_precision for r in U.precision_by_replicate(sums, U.number_blocks(sums, ["g"]), reps, ["g"], ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    days = sorted({a for *_, a, _ in rows})
    want = {}
    for g in "xy":
        w = U.weights(g, len(days), reps, 42)
        for rep in range(w.shape[1]):
            want[g, rep] = slow_precision([(p, y, w[days.index(a), rep]) for h, p, y, a, _ in rows if h == g])
    assert got == pytest.approx(want)


def test_weights_are_the_draws(spark):
    two = spark.createDataFrame([(e, b) for e in "ab" for b in range(11)], "e string, block_no long")
    for r in U.draws(two, 30, keys=["e"]).collect():
        assert U.draw_counts(r.e, 11, 30, 42)[r.block_no, r.rep] == r.mult
    assert (U.draw_counts("a", 11, 30, 42).sum(0) == 11).all()


def test_sums_of_replicates(spark):
    rows = [(e, d, float(d * d), d % 3) for e in "ab" for d in (3, 5, 8, 9)]
    sums = spark.createDataFrame(rows, "e string, anchor_pos long, kwh double, n int")
    got = {(r.e, r.rep): (r.kwh, r.n) for r in U.resampled(sums, U.number_blocks(sums, ["e"]), 5, ["e"], ["e"], ["kwh", "n"]).collect()}
    for (e, rep), pair in got.items():
        m = U.draw_counts(e, 4, 5, 42)[:, rep]
        assert pair == (sum(k * d * d for k, d in zip(m, (3, 5, 8, 9))), sum(k * (d % 3) for k, d in zip(m, (3, 5, 8, 9))))
    assert len(got) == 10


def test_one_to_one_refuses_repeated_keys(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    assert C.one_to_one(a, a.withColumnRenamed("a", "b"), ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        C.one_to_one(a, b, ["k"]).collect()


def test_join_coverage_fails_on_gaps_and_repeats(spark):
    rows = spark.range(100).selectExpr("id as k")
    ok = lambda lookup: C.join_coverage(rows, lookup.selectExpr("id as k"), ["k"]).first()
    assert ok(spark.range(100)).ok == 1 and ok(spark.range(1, 100)).ok == 1
    assert (ok(spark.range(2, 100)).ok, ok(spark.range(2, 100)).unmatched) == (0, 0.02)
    assert (ok(spark.range(100).union(spark.range(1))).ok, ok(spark.range(100).union(spark.range(1))).duplicate_keys) == (0, 1)


def test_reconcile_and_selection_rows(spark):
    a = spark.createDataFrame([("A", 14, 14), ("B", 21, 17), ("C", 1, 1)], "k string, n int, safe int")
    b = spark.createDataFrame([("A", 14, 14), ("B", 21, 16), ("D", 1, 1)], "k string, n int, safe int")
    assert {r.k: r.status for r in C.reconcile(a, b, ["k"], ["n", "safe"]).collect()} == {"A": "pass", "B": "fail", "C": "fail", "D": "fail"}
    rows = spark.createDataFrame([("m", "val", 1.0), ("m", "test", 2.0)], "model string, split string, test_kwh double")
    assert tuple(C.selection_rows(rows, ["model"]).first()) == ("m", 2, 1, 1)


def test_blend_needs_all_models(spark):
    scores = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.5), (2, "a", 0.6)], "k int, model string, p double")
    weights = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double")
    assert P.blend_long(scores.where("k = 1"), weights, ["k"], 2).first().p == pytest.approx(0.4)
    with pytest.raises(Exception, match="misaligned"):
        P.blend_long(scores, weights, ["k"], 2).collect()


def test_fixed_strategies_must_come_from_validation(spark):
    rows = spark.createDataFrame([(0, 0, s, 1 if s <= 8 else 0, 1.0, 0.9 if s <= 8 else 0.1) for s in range(1, 97)], "entity_id int, anchor_pos int, step int, empty int, kwh double, one double")
    rows = rows.withColumns({"two": F.col("one"), "three": F.col("one")})
    frozen = lambda split: spark.createDataFrame([(0, "s", 1.0, 0.0, 0.0, 0.8, split)], "entity_id int, strategy string, w1 double, w2 double, w3 double, threshold double, selection_split string")
    run = lambda split: P.evaluate_fixed(frozen(split), rows, rows, ["one", "two", "three"], ["entity_id"]).collect()
    (r,) = run("val")
    assert (r.recommended_intervals, r.conflict_intervals, r.recommended_windows, r.safe_windows, r.average_precision) == (8, 0, 1, 1, 1.0)
    with pytest.raises(Exception, match="selected on validation"):
        run("test")


def test_daily_anchors_fall_back_to_every_96th(spark):
    rows = spark.range(300).selectExpr("'a' as e", "id as pos", "timestamp_ntz'2024-01-01 06:00' + make_interval(0,0,0,0,0,15*cast(id as int)) as bin_start")
    assert sorted(r.pos for r in L.daily_anchors(rows, ["e"]).collect()) == [72, 168, 264]
    assert sorted(r.pos for r in L.daily_anchors(rows.where("hour(bin_start) > 0"), ["e"]).collect()) == [0, 96, 192, 288]
