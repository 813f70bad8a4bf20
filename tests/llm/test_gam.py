import zlib

import numpy as np
import pytest

from tidemill.llm.gam import FEATURES, Gam, fit_gam, fit_quality, keep_good, op8, score_quality, text_features


def test_features_of_odd_texts():
    for t in (None, b"", b" \n", b"x", "é".encode() * 9, b"a\0b" * 5000, b"A! B! C!\n\n\nx"):
        x = text_features(t)
        assert len(x) == len(FEATURES) and np.isfinite(x).all()


def test_fit_finds_shape_and_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(6000, 3))
    y = ((np.abs(x[:, 0]) < 1) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    m = fit_gam(x[:4000], y[:4000])
    assert ((m.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.93
    assert (1, 2) in m.pairs or (2, 1) in m.pairs


def test_degenerate_fits():
    assert Gam().score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert fit_gam(np.zeros((5, 2)), np.ones(5)).score(np.zeros((1, 2)))[0] == pytest.approx(6 / 7)
    assert len(fit_gam(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((0, 2)))) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op8(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good = [g.score for q, g in held if q]
    bad = [g.score for q, g in held if not q]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good])
    kept = np.mean([s >= 0.3 for s in good])
    print(len(good), len(bad), "auc", auc, "kept", kept, "caught", np.mean([s < 0.3 for s in bad]))
    assert auc > 0.9 and kept > 0.97


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "A b", "z"), (2, "w" * 70000, "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    assert score_quality(docs, model).count() == 4
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels.limit(0))).count() == 0
    assert keep_good(docs, Gam()).columns == docs.columns and keep_good(docs, Gam()).count() == 4
    assert keep_good(docs, Gam(base=-5.0)).count() == 0


def slow_score(model, x):
    """One row, entry by entry."""
    at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
    total = model.base + sum(t[b] for t, b in zip(model.tables, at)) + sum(t[at[i]][at[j]] for (i, j), t in model.pairs.items())
    return 1 / (1 + np.exp(-total))


def test_scores_equal_slow_scores(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
    assert got == pytest.approx({r.doc_id: slow_score(model, text_features((r.text or "").encode())) for r in docs.collect()}, abs=1e-12)


def slow_tree(g, h, leaves, damp):
    """All cuts tried one by one."""
    parts = [list(range(len(g)))]
    worth = lambda p: sum(g[i] for i in p) ** 2 / (sum(h[i] for i in p) + damp)
    for _ in range(leaves - 1):
        tries = [(worth(p[:k]) + worth(p[k:]) - worth(p), n, k) for n, p in enumerate(parts) for k in range(1, len(p))]
        best = max(tries, key=lambda t: t[0], default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        p = parts.pop(best[1])
        parts[best[1] : best[1]] = [p[: best[2]], p[best[2] :]]
    return [sum(g[i] for i in p) / (sum(h[i] for i in p) + damp) for p in parts for _ in p]


def test_boosting_equals_slow_boosting():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(150, 3))
    y = ((x[:, 0] > 0.3) | (x[:, 1] * x[:, 2] > 0.5)).astype(float)
    got = fit_gam(x, y, rounds=4, max_bins=6, n_pairs=0)
    p = (y.sum() + 1) / (len(y) + 2)
    base, tables = np.log(p / (1 - p)), [[0.0] * (len(e) + 1) for e in got.edges]
    at = [[sum(v >= e for e in edges) for v, edges in zip(row, got.edges)] for row in x]
    total = [base] * len(y)
    for _ in range(4):
        for j, table in enumerate(tables):
            q = [1 / (1 + np.exp(-t)) for t in total]
            g, h = [0.0] * len(table), [0.0] * len(table)
            for i, b in enumerate(at):
                g[b[j]] += y[i] - q[i]
                h[b[j]] += q[i] * (1 - q[i])
            step = [0.1 * v for v in slow_tree(g, h, 3, 5.0)]
            for k, v in enumerate(step):
                table[k] += v
            total = [t + step[b[j]] for t, b in zip(total, at)]
    assert got.base == pytest.approx(base)
    for mine, slow in zip(got.tables, tables):
        assert mine == pytest.approx(slow)


def test_equal_texts_score_alike(spark):
    """Repeated rows, null and empty texts: equal texts have equal scores, and the stage keeps or drops them together."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_quality(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    texts = [None, "", " ", "one two three", "A LINE | ! | " * 50, "plain words in a row. " * 30_000]
    frame = spark.createDataFrame([(i % 4, t, "clash") for t in texts for i in range(3)], "doc_id long, text string, score string")
    by = {}
    for r in score_quality(frame.repartition(4), model).collect():
        by.setdefault(r.doc_id, []).append(r.score)
    scores = [s for v in by.values() for s in v]
    assert len(scores) == 18 and all(0 <= s <= 1 for s in scores)
    want = sorted(slow_score(model, text_features((t or "").encode())) for t in texts for _ in range(3))
    assert sorted(scores) == pytest.approx(want, abs=1e-12)
