import base64
import hashlib
import math
import random

import numpy as np
import xxhash

from tidemill.llm.improbable import BITS, FEATURES, HASHES, NEIGHBOURS, POINTS, TRIVIAL, WINDOW, digest, features, fingerprint_pairs, likeness, window_surprise


def entropy(w):
    return -sum(c / len(w) * math.log2(c / len(w)) for c in (w.count(x) for x in set(w)))


def slow_features(text):
    e = [entropy(text[i : i + WINDOW]) for i in range(len(text) - WINDOW + 1)]
    rank = [round(x * 1000) if x >= TRIVIAL else 10**9 for x in e]
    if len(rank) <= NEIGHBOURS:
        return [min(range(len(rank)), key=lambda i: rank[i])] if min(rank) < 10**9 else []
    points = [0] * len(rank)
    for i in range(len(rank) - NEIGHBOURS + 1):
        points[min(range(i, i + NEIGHBOURS), key=lambda k: rank[k])] += 1
    return [i for i, p in enumerate(points) if p >= POINTS and rank[i] < 10**9]


def test_surprise_and_features_equal_brute_force():
    rnd = random.Random(8)
    for n in (64, 65, 100, 127, 128, 129, 700):
        for pool in (b"ab", b"the quick brown fox", bytes(range(256)), b"a"):
            text = bytes(rnd.choices(pool, k=n))
            s = window_surprise(np.frombuffer(text, np.uint8))
            assert np.allclose(6 - s / WINDOW / 65536, [entropy(text[i : i + WINDOW]) for i in range(n - WINDOW + 1)], atol=1e-3)
            got = features(np.frombuffer(text, np.uint8)).tolist()
            ranks = np.round(6000 - s / WINDOW / 65.536)
            if len(set(ranks.tolist())) == len(ranks):  # no ties, which the two round differently
                assert got == slow_features(text)


def prose(rnd, n):
    words = ["".join(rnd.choices("abcdefghijklmnoprstuw", k=rnd.randint(2, 9))) for _ in range(400)]
    return " ".join(rnd.choices(words, k=n))


def test_likeness_orders():
    rnd = random.Random(2)
    a, b = prose(rnd, 3000).encode(), prose(random.Random(3), 3000).encode()
    part = a[: len(a) // 2] + b[: len(b) // 2]
    assert likeness(digest(a), digest(a)) == 1.0 and likeness(digest(a), digest(b)) < 0.15
    assert 0.35 < likeness(digest(a), digest(part)) < 0.9 and likeness(digest(b), digest(part)) > 0.35
    assert likeness(digest(a), digest(part)) == likeness(digest(part), digest(a))
    assert likeness(b"", b"") == 1.0 and likeness(b"", digest(b"x")) == 0.0
    assert digest(b"a" * 500) != digest(b"b" * 500) and len(digest(b"short")) == 256


def exact_features(text):
    """Places of features by counting each window's bytes; equal ranks go to the first."""
    term = [0, *(round(c * math.log2(c) * 65536) for c in range(1, WINDOW + 1))]
    most, count, s, ranks = WINDOW * 6 * 65536, [0] * 256, 0, []
    for i, x in enumerate(text):
        if i >= WINDOW:
            y = text[i - WINDOW]
            s += term[count[y] - 1] - term[count[y]]
            count[y] -= 1
        s += term[count[x] + 1] - term[count[x]]
        count[x] += 1
        if i >= WINDOW - 1:
            ranks.append(most - s if s <= most - TRIVIAL * WINDOW * 65536 else most + 1)
    if len(ranks) <= NEIGHBOURS:
        best = ranks.index(min(ranks))
        return [best] if ranks[best] <= most else []
    points = [0] * len(ranks)
    for i in range(len(ranks) - NEIGHBOURS + 1):
        part = ranks[i : i + NEIGHBOURS]
        points[i + part.index(min(part))] += 1
    return [i for i, p in enumerate(points) if p >= POINTS and ranks[i] <= most]


def slow_digest(text):
    """Filters as sets of bits."""
    if not text:
        return []
    found = [text[p : p + WINDOW] for p in exact_features(text)] if len(text) >= WINDOW else []
    filters = []
    for i, f in enumerate(found or [text]):
        if i % FEATURES == 0:
            filters.append(set())
        h = xxhash.xxh3_64_intdigest(f)
        filters[-1] |= {h >> 11 * k & BITS - 1 for k in range(HASHES)}
    return filters


def as_bytes(filters):
    out = bytearray(len(filters) * BITS // 8)
    for i, bits in enumerate(filters):
        for b in bits:
            out[i * BITS // 8 + b // 8] |= 128 >> b % 8
    return bytes(out)


def slow_likeness(x, y):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    if len(x) > len(y) or (len(x) == len(y) and as_bytes(x) > as_bytes(y)):
        x, y = y, x
    total = 0.0
    for a in x:
        chance = [len(a) * len(b) / BITS for b in y]
        best = max((len(a & b) - c) / max(min(len(a), len(b)) - c, 1e-9) for b, c in zip(y, chance))
        total += min(max(best, 0.0), 1.0) * len(a)
    return min(total / sum(map(len, x)), 1.0)


def check(spark, rows, frame):
    """Against filters and likeness made bit by bit."""
    got = sorted(fingerprint_pairs(frame).collect(), key=lambda r: str(tuple(r)[:5]))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, show, known = [], lambda d: base64.b64encode(as_bytes(d)).decode(), {}
    slow = lambda t: known.get(t) or known.setdefault(t, slow_digest(t.encode()))
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        d, de, dn = slow(t), slow(e), slow(after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), show(d), show(de), slow_likeness(d, de), slow_likeness(d, dn)))
    want.sort(key=lambda r: str(r[:5]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([tuple(r)[5:] for r in got] or [(0, 0)], [r[5:] for r in want] or [(0, 0)], atol=1e-5)


def test_features_with_ties():
    rnd = random.Random(5)
    for pool in (b"ab", b"abcabcabc ", b"aaaaaaaaab"):
        for n in (64, 127, 128, 400):
            text = bytes(rnd.choices(pool, k=n)) + b"tail of it" * 12
            assert features(np.frombuffer(text, np.uint8)).tolist() == exact_features(text)
            assert digest(text) == as_bytes(slow_digest(text))


def test_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    check(spark, rows, frame)
    far = [r for r in fingerprint_pairs(frame).collect() if r.n_chars > 400]
    assert np.mean([r.near_edited for r in far]) > 0.3 > 3 * np.mean([r.near_next for r in far])


def test_odd_rows(spark):
    rnd = random.Random(1)
    texts = [None, "", "x", "éé", "a" * 9000, prose(rnd, 30000), prose(rnd, 50), "🎉" * 90, prose(rnd, 40)]
    for rows in (list(zip([5, 3, -2, 900, 7, 8, 9, 10, 2**40], texts)), [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, None), (4, "x")], [(3, "one")], []):
        frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, near_next double").repartition(4)
        check(spark, rows, frame)
