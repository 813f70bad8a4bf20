"""Small fits: shapes, ranges and that a signal is found; and bins of a stream with late rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import linear_maps as LM
from tidemill.operators import models as ML
from tidemill.sources import scratch
from tidemill.streaming.bins import closed_bins


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for split in ("train", "val", "test"):
        for i in range(300):
            a, b = rng.random(), rng.random()
            out.append((split, i, a, b, int(a > 0.5) if rng.random() < 0.95 else int(a <= 0.5)))
    return spark.createDataFrame(out, "split string, i int, a double, b double, empty int")


def test_fit_and_score_finds_the_signal(rows):
    scored = ML.fit_and_score(rows, ["a", "b"], ML.linear)
    assert scored.where("split = 'train'").count() == 0 and scored.count() == 600
    right = scored.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("empty")).cast("int"))).first()[0]
    assert right > 0.85


def test_importance_ranks_the_feature_that_matters(rows):
    got = {r.feature: r["drop"] for r in ML.permutation_importance(rows, ["a", "b"], ML.linear, ["a", "b"], parts=4).collect()}
    assert got["a"] > 0.2 and abs(got["b"]) < 0.1


def test_seeds_give_different_trees(rows):
    m = ML.fit_and_score_seeds(rows, ["a", "b"], lambda s: ML.gbt(s, 3), (1, 2))
    assert m.groupBy("seed").count().count() == 2


def test_closed_bins_wait_for_late_rows(spark):
    """The second file moves the watermark; its late row within the hour still counts, one beyond is dropped."""
    from tempfile import mkdtemp

    place = mkdtemp(prefix="spark-")
    schema = "e int, ts timestamp, value double"
    for i, part in enumerate(([("2024-01-01 00:01", 1.0), ("2024-01-01 00:40", 9.0)], [("2024-01-01 00:02", 3.0), ("2024-01-01 03:00", 5.0)], [("2024-01-01 00:03", 100.0), ("2024-01-01 06:00", 5.0)])):
        df = spark.createDataFrame([(1, t, v) for t, v in part], "e int, t string, value double").select("e", F.to_timestamp("t").alias("ts"), "value")
        df.coalesce(1).write.parquet(f"{place}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{place}/in/*")
        q = closed_bins(stream, ["e"]).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r.bin_start)[11:16]: (r.n, r.mean) for r in spark.read.parquet(f"{place}/out").collect()}
    assert got["00:00"] == (2, 2.0) and got["00:30"] == (1, 9.0) and "06:00" not in got


def test_shared_folder_is_never_guessed_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
    Context.master = "local[2]"
    assert scratch.shared_dir(Session()) == scratch.shared_dir(Session())


def test_tables_are_written_once_within_a_query(spark):
    made = []

    @scratch.once
    def numbers(spark, d):
        made.append(d)
        return spark.range(3)

    assert numbers(spark, "a").count() == 3 and made == ["a"]
    with scratch.shared():
        assert numbers(spark, "a").count() + numbers(spark, "a").count() == 6
    assert made == ["a", "a"]
    with scratch.discarding(spark):
        path = scratch.fresh_path(spark, "x")
        spark.range(2).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def slow_map(x, y, ridge, rounds=100):
    """Newton's rounds for one step's weighted logistic fit; the intercept comes last and bears no penalty."""
    positive = min(max((y.size - y.sum()) / max(y.sum(), 1), 0.25), 8.0)
    out = []
    ones = np.hstack([x, np.ones((len(x), 1))])
    for j in range(y.shape[1]):
        w = np.zeros(ones.shape[1])
        penalty = np.diag([ridge] * x.shape[1] + [0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-ones @ w))
            c = np.where(y[:, j] > 0, positive, 1.0)
            w = w - np.linalg.solve(ones.T @ (ones * (c * p * (1 - p))[:, None]) + penalty, ones.T @ (c * (p - y[:, j])) + penalty @ w)
        out.append(w)
    return np.array(out)


@pytest.mark.parametrize("chunk", [7, 10**6])
def test_linear_maps_are_those_of_plain_fits(spark, chunk):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for e in "ab":
        x = rng.normal(size=(60, 5))
        y = (x @ rng.normal(size=(5, 5)) + rng.normal(size=(60, 5)) > 0.3).astype(float)
        rows += [(e, "train", i, x[i].tolist(), y[i].tolist()) for i in range(60)] + [(e, "val", 100, x[0].tolist(), y[0].tolist())]
        want[e] = slow_map(x, y, 1.0)
    df = spark.createDataFrame(rows, "e string, split string, pos long, x array<double>, y array<double>").repartition(3)
    maps = LM.fit_maps(df, ["e"], 5, chunk=chunk)
    for r in maps.collect():
        assert np.allclose(r.coefficients, want[r.e][r.step - 1], atol=1e-7)
    assert maps.count() == 10
    for r in LM.score_maps(df.where("split = 'val'"), maps, ["e"]).collect():
        x = next(x for e, s, _, x, _ in rows if e == r.e and s == "val")
        assert r.p == pytest.approx(1 / (1 + np.exp(-np.append(x, 1.0) @ want[r.e][r.step - 1]))) and r.anchor_pos == 100 and r.empty in (0, 1)


def test_windows_of_linear_maps(spark):
    bins = spark.createDataFrame([("a", p, p % 3 == 0, 1 - (p % 3 == 0)) for p in range(40)], "e string, pos long, occupied boolean, empty int").withColumn("occupied", F.col("occupied").cast("int"))
    bins = bins.withColumn("bin_start", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 15 * cast(pos as int))"))
    anchors = bins.where("pos in (2, 10, 35, 38)").selectExpr("e", "pos", "'val' as split", "bin_start", "timestamp_ntz'2024-01-01 05:00' as b1")
    got = {r.pos: r for r in LM.windows(bins, anchors, ["e"], 4).collect()}
    assert sorted(got) == [10, 35]  # the others lack history or targets
    occupied = [int(p % 3 == 0) for p in range(20)]
    mean, dev = np.mean(occupied), np.std(occupied)
    assert got[10].x == pytest.approx([(int(p % 3 == 0) - mean) / dev for p in (7, 8, 9, 10)])
    assert got[10].y == [float(p % 3 != 0) for p in (11, 12, 13, 14)]


def test_seeds_are_fitted_together_and_averaged(rows):
    parts = [rows.where(F.col("split") != "test").where(F.col("i") % 2 == k) for k in (0, 1)]
    models = ML.fit_seeds(parts, ["a", "b"], lambda s: ML.stopped_gbt(s, 40), (1, 2))
    assert all(1 <= m.getNumTrees < 40 for m in models)  # validation rows ended both
    test = rows.where("split = 'test'")
    got = {r.i: r.p for r in ML.mean_of_models(models, test, ["a", "b"]).collect()}
    each = [{r.i: r.p for r in ML.mean_of_models([m], test, ["a", "b"]).collect()} for m in models]
    assert all(got[i] == pytest.approx((each[0][i] + each[1][i]) / 2) for i in got) and each[0] != each[1]


def test_no_fit_learns_from_validation_rows(spark):
    """Validation labels are all turned round; neither a forest nor stopped trees follow them."""
    rng = random.Random(6)
    made = [("train" if i % 2 else "val", a, int((a > 0.5) == bool(i % 2))) for i, a in enumerate(rng.random() for _ in range(600))]
    rows = spark.createDataFrame(made, "split string, a double, empty int")
    for make in (lambda s: ML.forest(s, 5), lambda s: ML.stopped_gbt(s, 5), lambda s: ML.gbt(s, 3)):
        (model,) = ML.fit_seeds([rows], ["a"], make, (1,))
        p = {r.a > 0.5: r.p for r in ML.mean_of_models([model], spark.createDataFrame([(0.1,), (0.9,)], "a double"), ["a"]).collect()}
        assert p[True] > 0.5 > p[False]
