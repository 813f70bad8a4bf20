import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemill.llm import centroids as C

MOST = 2**63 - 1


def slow(rows, k=8, rounds=10, dim=64):
    """Plain rounds over Python integers."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [v for _, v in first[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((square(v, c), n) for n, c in enumerate(now))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(now)]
    met = [(i, *nearest(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in met if m == n) for n in range(len(now))}
    fits = lambda x: x if x <= MOST else None
    alone = {n: fits(t) if all(d <= MOST for _, d, m in met if m == n) else None for n, t in total.items()}
    whole = fits(sum(total.values())) if all(d <= MOST for _, d, _ in met) else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, n, fits(d), alone[n], whole, sha[n]) for i, d, n in met), key=str)


def run(spark, rows, kind="float", **more):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in rows], f"vec_id long, embedding array<{kind}>, cluster string, v int")
    return sorted(map(tuple, C.cluster(frame.repartition(3), **more).collect()), key=str)


def vectors(n, dim, seed, kinds=6):
    rnd = random.Random(seed)
    middles = [[rnd.randint(-4096, 4096) / 1024 for _ in range(dim)] for _ in range(kinds)]
    return [(i, [m + rnd.randint(-900, 900) / 2048 for m in rnd.choice(middles)]) for i in range(n)]


def test_odd_rows_and_ties(spark):
    rows = vectors(120, 4, 1)
    rows += [(7, rows[3][1]), (7, rows[3][1]), (3, rows[9][1]), (None, rows[5][1]), (200, None), (201, [1.0] * 3), (202, []), (203, [1.0, None, 1.0, 1.0])]
    rows += [(204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), *[(300 + i, [0.5, 0.5, -0.5, 0.0]) for i in range(40)]]
    assert run(spark, rows, dim=4) == slow(rows, dim=4)
    assert run(spark, rows, dim=4, k=40, rounds=3) == slow(rows, k=40, rounds=3, dim=4)


def test_components_of_any_size(spark):
    rows = vectors(60, 3, 2) + [(100, [1e6, -1e6, 3.0]), (101, [3e38, 1.0, 0.0]), (102, [-3e38, 1e20, 0.0]), (103, [1e7, 2e7, 3e7])]
    assert run(spark, rows, "double", dim=3, rounds=4) == slow(rows, dim=3, rounds=4)
    rows = vectors(20, 2, 3) + [(100, [1.7e308, -1.7e308]), (101, [1e300, 1e-300])]
    assert run(spark, rows, "double", dim=2, k=3, rounds=3) == slow(rows, k=3, rounds=3, dim=2)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = vectors(n, 2, 4)
    assert run(spark, rows, dim=2) == slow(rows, dim=2)


def test_equal_vectors_leave_clusters_empty(spark):
    rows = [(i, [1.5, -0.25]) for i in range(30)] + [(50, [1.5, -0.25 + 1 / 1024])]
    assert run(spark, rows, dim=2) == slow(rows, dim=2)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("leaf", [1, 2, 7])
def test_tree_finds_nearest(leaf, large):
    rnd = random.Random(leaf)
    unit = 10**20 if large else 1
    centres = [[rnd.randint(-30, 30) * unit for _ in range(3)] for _ in range(90)]
    centres += centres[:5]
    tree = C.VantageTree(centres, leaf)
    x = np.array([[rnd.randint(-40, 40) * unit + rnd.randint(0, 1) for _ in range(3)] for _ in range(400)] + centres, object if large else np.int64)
    who, d = tree.nearest(x)
    want = [min((sum((p - q) ** 2 for p, q in zip(v, c)), n) for n, c in enumerate(centres)) for v in x.tolist()]
    assert list(zip(d.tolist(), who.tolist())) == want


def test_tree_leaves_most_leaves_alone(monkeypatch):
    rnd = np.random.default_rng(0)
    centres = rnd.integers(-(10**6), 10**6, (256, 2))
    tree = C.VantageTree(centres.tolist())
    met = []
    plain = np.unique
    monkeypatch.setattr(C.np, "unique", lambda a: met.append(len(a)) or plain(a))
    tree.nearest(rnd.integers(-(10**6), 10**6, (500, 2)))
    assert sum(met) < 500 * len(tree.nodes) / 4  # nodes that vectors visit


def test_limbs():
    for v in (0, 1, -1, 2**40, -(2**40), 10**60 + 7, -(10**60) - 2**80):
        assert sum(part << C.LIMB * i for i, part in C.limbs(v)) == v
