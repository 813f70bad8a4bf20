import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tidemill.llm import repeats, suffix_dedup
from tidemill.llm.suffix_dedup import removed, without_repeats


def slow(rows, window):
    """rows: (id, text) in order of precedence."""
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def nested(rnd):
    texts = []
    for _ in range(rnd.randint(1, 6)):
        t = bytes(rnd.choices(b"ab\0", k=rnd.randint(1, 40)))
        texts.append(t + rnd.choice(texts) + t[:3] if texts and rnd.random() < 0.6 else t)
    return texts


def test_suffix_array_and_maximal_repeats():
    rnd = random.Random(2)
    for _ in range(200):
        texts = nested(rnd)
        texts += rnd.choices(texts, k=rnd.randint(0, 3))
        size = [len(t) for t in texts]
        at = np.concatenate(([0], np.cumsum(size)))
        buf, begins, ends = np.frombuffer(b"".join(texts), np.uint8), np.repeat(at[:-1], size), np.repeat(at[1:], size)
        cap, least = rnd.choice([14, 28, 1000]), rnd.randint(2, 8)
        order, shared = rnd.choice([repeats.suffix_array(buf, ends, cap), repeats.suffixes(buf, begins, ends, cap)])
        suffix = [bytes(buf[i : ends[i]]) for i in order]
        for k in range(1, len(order)):
            a, b = suffix[k - 1], suffix[k]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, cap) and (n >= cap or a <= b)
        group, length, place = repeats.maximal_repeats(buf, begins, ends, least, cap)
        for g in set(group.tolist()):
            at_g = place[group == g]
            n = int(length[group == g][0])
            text = bytes(buf[at_g[0] : at_g[0] + n])
            if n < cap:  # all occurrences, and none longer to either side
                assert sorted(at_g) == [p for p in range(len(buf)) if p + n <= ends[p] and bytes(buf[p : p + n]) == text]
                assert len({p == begins[p] or buf[p - 1] for p in at_g}) > 1 or any(p == begins[p] for p in at_g)
                assert len({buf[p + n] if p + n < ends[p] else -1 - p for p in at_g}) > 1


def test_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in removed(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == set(slow(sorted(rows), 100))


def test_suffix_array_meets_every_repeat():
    """Of equal blocks two are compared by the suffix array; only third and further ones are settled by the second."""
    f = lambda *x: np.array(x)
    body = f(5, 5, 5, 5, 6, 9)
    b = suffix_dedup._block_rows(f(1, 1, 1, 1, 1, 2).astype(np.uint64), body.astype(np.uint64), f(1, 2, 3, 4, 4, 9), f(0, 0, 0, 0, 7, 0), f(3, 3, 3, 3, 3, 3), body < 0)
    assert b.column("kind").to_pylist() == [0, 0, suffix_dedup.KNOWN, suffix_dedup.KNOWN, 0, 0]
    plain = b.filter(pa.compute.equal(b.column("kind"), 0))
    for cut in range(1, plain.num_rows):  # wherever a batch ends
        found = [r for x in suffix_dedup._resolve(iter((plain.slice(0, cut), plain.slice(cut)))) for r in x.to_pylist()]
        assert sorted((r["doc"], r["contested"]) for r in found) == [(1, True), (2, True), (4, True)]
    many = np.arange(20)
    b = suffix_dedup._block_rows(many.astype(np.uint64) * 0, many.astype(np.uint64), many, many, many * 0 + 1, many < 0)
    assert b.column("kind").to_pylist() == [0, 0] + [suffix_dedup.SALTED] * 18
    found = [r for x in suffix_dedup._resolve(iter((b.slice(2, 1), b.slice(3)))) for r in x.to_pylist()]
    assert len(found) == 18 and all(r["contested"] for r in found)


def test_long_strings_of_one_byte(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    rows = list(enumerate(["a" * 5000, "b" + "a" * 900, "a" * 130 + "b" * 500]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in removed(frame, limit=200).collect()} == set(slow(rows, 100))


@pytest.mark.parametrize("limit", [1 << 23, 5000, 300])
def test_odd_texts(spark, limit):
    rnd = random.Random(4)
    passage = "".join(rnd.choices("abcdefgh é", k=240))
    other = "".join(rnd.choices("abcdefgh é", k=240))
    texts = [None, "", "x", "a" * 99, "a" * 100, "a" * 700, "ab" * 400, passage, passage, "q" + passage[3:180] + "zz" + other, other[40:] + passage[:130] + passage]
    texts += ["".join(rnd.choices("xyz", k=50)) + passage + "".join(rnd.choices("xyz", k=50)) for _ in range(30)]
    texts += ["\0" * 150, "\0" * 150 + "b", (passage + other) * 40]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], "doc_id long, text string, key string, start int").repartition(5)
    assert {tuple(r) for r in removed(frame, limit=limit).collect()} == set(slow(rows, 100))


def test_repeated_ids_and_empty(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, t), (1, t), (None, t), (1, None), (0, "b")]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow(order, 100)))
    assert removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_without_repeats(spark):
    t = "é" * 60 + "".join(random.Random(1).choices("abcdefgh", k=300))
    frame = spark.createDataFrame([(7, 0, t, "a"), (8, 1, "x" + t[1:] + "y", "b"), (9, 2, None, "c")], "n_chars int, doc_id long, text string, doc string")
    got = without_repeats(frame)
    assert got.columns == frame.columns and got.dtypes == frame.dtypes
    assert sorted(map(tuple, got.collect())) == [(0, 2, "", "c"), (2, 1, "xy", "b"), (301, 0, "é" + t[60:], "a")]


def test_a_task_holds_blocks_of_few_bytes_at_once(monkeypatch):
    """A batch with many bytes of texts gives its blocks in parts; together they are those of one part."""
    rng = random.Random(9)
    texts = [rng.randbytes(rng.randrange(50, 4000)) for _ in range(300)]
    doc = list(range(300))
    rng.shuffle(doc)
    batch = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([0] * 300, pa.int32()), pa.array(texts)], ["doc", "start", "text"])
    monkeypatch.setattr(suffix_dedup, "LAID", 1 << 14)
    found = {}
    for together in (1 << 30, 1 << 17):
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        found[together] = [out.to_pylist() for out in suffix_dedup._scan(100, 32)(iter([batch]))]
    whole, parts = found.values()
    assert len(whole) == 1 and len(parts) >= 4 and max(map(len, parts)) < len(whole[0]) / 3
    assert [r for part in parts for r in part] == whole[0]
