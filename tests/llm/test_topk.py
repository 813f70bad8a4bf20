import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemill.llm.topk import op9, order_key, top_k


def slow(rows, k=5, every=50):
    floor = lambda x: math.floor(Fraction(x) * 256)
    vecs = [(i, [floor(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, mine) in enumerate(vecs):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v)), c) for m, (c, v) in enumerate(vecs) if m != n)[:k]
            out += [(q, r + 1, c, -s if abs(s) < 2**63 else None) for r, (s, c) in enumerate(scores)]
    return sorted(out, key=str)


def run(spark, rows, kind="float", **more):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, chunk string")
    return sorted(map(tuple, top_k(frame.repartition(3), **more).collect()), key=str)


def test_all_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op9(spark, sf).collect()), key=str) == slow(rows)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_ties_and_odd_rows(spark, chunk):
    rnd = random.Random(6)
    f = lambda n: [rnd.randint(-512, 512) / 256 for _ in range(n)]
    same = f(6)
    rows = [(i, same) for i in range(100, 180)] + [(i, f(6)) for i in range(300, 500)] + [(i, [0.0] * 6) for i in range(-60, -45)]
    rows += [(1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")]), (None, f(6)), (1200, []), (1250, f(3)), (1300, f(9)), (350, f(6)), (350, f(6))]
    assert run(spark, rows, chunk=chunk, n_pivots=5) == slow(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [-1.0])]) == [(0, 1, 7, -65536)]
    assert run(spark, [(1, [1.0]), (7, [-1.0])]) == []


def test_rows_with_equal_ids_are_all_candidates(spark):
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0])]
    assert run(spark, rows) == [(50, 1, 1, 196608), (50, 2, 1, 131072), (50, 3, 1, 65536)]
    assert run(spark, [*rows, (50, [4.0, 1.0])]) == slow([*rows, (50, [4.0, 1.0])])


def test_components_of_any_size(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randint(-512, 512) / 256 for _ in range(3)]) for i in range(120)]
    one = [(200, [1e6, -1e6, 0.5]), (201, [1e6, 1.0]), (250, [-3e38, 1e20, 0.0]), (50, [3e38, 1.0, 1.0])]
    assert run(spark, rows + one, chunk=16) == slow([(i, [float(np.float32(x)) for x in v]) for i, v in rows + one])
    most = [(300, [1.7e308, -1.7e308]), (301, [1e300]), (302, [5e-324, 1.7e308])]
    assert run(spark, rows + most, "double", chunk=50) == slow(rows + most)
    assert run(spark, most, "double") == slow(most)


def test_bounds_save_visits(spark):
    """Rows in tight groups of like length: a query needs few chunks beyond its own group's."""
    rnd = random.Random(9)
    middles = [[rnd.choice((-1, 1)) * 2.0 for _ in range(8)] for _ in range(12)]
    rows = [(i, [m + rnd.randint(-8, 8) / 256 for m in middles[i % 12]]) for i in range(2400)]
    assert run(spark, rows, chunk=20, n_pivots=24) == slow(rows)


def test_keys_sort_as_integers():
    rnd = random.Random(1)
    values = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63)] + [rnd.choice((-1, 1)) * rnd.getrandbits(rnd.randint(1, 3000)) for _ in range(300)]
    assert sorted(values, key=order_key) == sorted(values)
