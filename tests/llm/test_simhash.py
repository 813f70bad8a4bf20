from itertools import combinations
import random
import re

import numpy as np
import xxhash

from tidemill.llm import components, simhash
from tidemill.llm.components import connected_components
from tidemill.llm.simhash import WIDE_BITS, WIDE_SHARED, covering_triples, fingerprint_links, near_duplicates, one_of_each, position_pairs, rarest, rest_candidates, similar, wide_candidates, wide_roots


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def spread(x):
    """The splitmix64 finaliser on Python integers."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def slow_wide(text):
    """Four 64-bit words from shingles of five words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return (0, 0, 0, 0)
    first = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))]
    each = [first, *([spread((h + i * 0x9E3779B97F4A7C15) % 2**64) for h in first] for i in (1, 2, 3))]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) for hashes in each)


def slow_wide_link(a, b):
    """Wide fingerprints that share a posted pair of positions, enough bytes and nearly all bits."""
    same = [i for i in range(32) if (a[i // 8] ^ b[i // 8]) >> 8 * (i % 8) & 255 == 0]
    bits = sum((x ^ y).bit_count() for x, y in zip(a, b))
    return bits <= WIDE_BITS and len(same) >= WIDE_SHARED and any(i % 6 == j % 6 for i, j in combinations(same, 2))


def slow_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_similar(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def slow_near_classes(docs):
    """Smallest id of each document's class, by all pairs of texts."""
    sets = {i: slow_set(t) for i, t in docs.items()}
    return slow_classes(sets, slow_similar)


def slow_classes(fps, linked=lambda a, b: (a ^ b).bit_count() <= 4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if linked(fps[a], fps[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_any_four_positions_hold_a_triple():
    triples = covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


def test_matches_all_pairs(spark):
    base = " ".join(f"word{i * i % 97}" for i in range(300))
    texts = [base.replace("word1 ", f"other{i} ", 1) for i in range(40)] + [base, base, None, "", " \n", "A b", "a B", "x" * 70000, "é Ü é ü a"]
    docs = {i: t for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs.items()], "doc_id long, text string, fp string, component_id int")
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = {(i, f"{fps[i]:016x}", c) for i, c in slow_classes(fps).items()}
    for limit in (4096, 2):
        assert {tuple(r) for r in near_duplicates(frame, limit=limit).collect()} == want


def test_hot_lists_lose_nothing(spark):
    # fingerprints that share four bytes and walk through the others bit by bit
    fps = {i: (0xAABBCCDD << 32) ^ (i * 0x01010101 * 7 & 0xFFFFFFFF) for i in range(200)}
    frame = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "node long, fp long")
    want = slow_classes(fps)
    for limit in (4096, 3):
        root = {i: i for i in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in fingerprint_links(frame, limit).collect():
            a, b = find(r.src), find(r.dst)
            root[max(a, b)] = min(a, b)
        assert {i: find(i) for i in fps} == want


def test_wide_pairs_cover_seven_positions():
    pairs = position_pairs()
    assert len(pairs) == 70
    assert not any(i % 6 == j % 6 for i, j in combinations(range(6), 2))  # six positions may miss, seven can't


def edited(words, every, tag):
    return " ".join(w if i % every else f"{tag}{i}" for i, w in enumerate(words))


def test_near_copies_are_those_of_all_pairs(spark):
    words = [f"word{i * i % 997}" for i in range(400)]
    texts = [edited(words, 40 + 9 * i, f"x{i}_") for i in range(30)] + [" ".join(words), " ".join(words).upper(), None, "", "one two", "One  two", " ".join(words[::-1])]
    texts += [edited(words[:300], 55 + i, "y") for i in range(12)] + ["same line here again now " * 60 + f"only {i} of these words differ from the others" for i in range(3)]
    docs = {i: t for i, t in enumerate(texts)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = {i for i, c in slow_near_classes(docs).items() if i == c}
    assert 6 <= len(want) < 30
    for limit in (1 << 14, 2):
        assert {r.doc_id for r in wide_roots(frame, limit=limit).collect()} == want


def test_no_similar_pair_is_missed(spark):
    """Pairs at a similarity just above 0.8, whose fingerprints often share few bytes, and a long list of a common line."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, texts = new(14), []
    for i in range(300):
        a = new(14) if i % 2 else line + new(5)
        texts += [a, a[:-1] + new(1)]
    docs = {i: " ".join(w) for i, w in enumerate(rng.sample(texts, len(texts)))}
    want = {i for i, c in slow_near_classes(docs).items() if i == c}
    got = {r.doc_id for r in wide_roots(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert len(want) == 300 and got == want


def test_rest_is_found_without_any_order_or_class(spark):
    """Pairs of different classes that may be similar, in lists longer and shorter than eight, hold all that are similar."""
    rng = random.Random(6)
    base = list(range(60))
    sets = {i: np.array(sorted(rng.sample(base, 60 - i % 14)), np.uint64) for i in range(60)}
    sets |= {100 + i: np.array([1000 + i // 3 * 20 + j for j in range(10 + i % 3)], np.uint64) for i in range(30)}
    for counts in ({}, {s: 5 + s % 3 for s in range(0, 60, 2)}):
        known, n = np.array(sorted(counts), np.uint64), np.array([counts[k] for k in sorted(counts)], np.int64)
        rows = [(i, len(s), rarest(s, known, n).view(np.int64).tolist()) for i, s in sets.items()]
        nodes = spark.createDataFrame(rows, "node long, size long, prefix array<long>")
        for classes in ({}, {i: 0 for i in range(1, 40)}):
            roots = spark.createDataFrame(list(classes.items()), "node long, root long")
            pairs = {tuple(r) for r in rest_candidates(nodes, roots).collect()}
            want = {(a, b) for a, b in combinations(sorted(sets), 2) if similar(sets[a], sets[b]) and classes.get(a, a) != classes.get(b, b)}
            assert want and want <= pairs and all(a < b and classes.get(a, a) != classes.get(b, b) for a, b in pairs)


def test_sketches_bound_what_differs():
    """Of sets of any two sizes: differing bits are never more than the elements of one only, so no similar pair is dropped."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 31, 32, 33, 200, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for gone, new in ((0, 0), (n // 9, 0), (n // 10, n // 10), (0, n // 4), (n, n), (n // 2, 7 * n)):
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 2**63, new).astype(np.uint64))))
            apart, found = len(np.setxor1d(a, b)), simhash.differing(simhash.sketch(a), simhash.sketch(b))
            assert found <= apart and (found - apart) % 2 == 0
            if n >= 200 and apart >= len(a):  # far from similar, and told
                assert 9 * found > len(a) + len(b)


def test_few_texts_are_fetched_for_pairs(spark, monkeypatch):
    """Different texts that share a rare shingle: none is fetched, as their sketches tell them apart, and similar ones are."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    common = new(6)
    docs = {i: " ".join(common + new(40)) for i in range(40)}
    docs |= {100: docs[7] + " more", 101: " ".join(new(30)), 102: None}
    asked = []
    held = simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda pairs, texts: asked.append((pairs.count(), texts.count())) or held(pairs, texts))
    stay = {r.doc_id for r in one_of_each(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert stay == set(docs) - {100}
    assert sum(pairs for pairs, _ in asked) == 1 and max(texts for _, texts in asked) == 2


def test_flags_miss_no_id(spark):
    rows = spark.range(-3000, 3000).selectExpr("id as k", "cast(id as string) as text")
    ids = spark.createDataFrame([(i,) for i in (*range(-3000, 3000, 7), 2**62, -(2**63))], "k long")
    got = simhash.flagged(rows, ids, "k")
    assert got.columns == ["k", "text", "k_may"] and got.count() == 6000
    may = {r.k for r in got.where("k_may").collect()}
    assert set(range(-3000, 3000, 7)) <= may and len(may) < 1.1 * 6000 / 7
    assert simhash.flagged(rows, ids.limit(0), "k").where("k_may").isEmpty()


def test_rounds_of_few_links_write_few_files(spark, monkeypatch):
    """A round writes a file for each 1,024 links, not for each partition; the result is the same for any number."""
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 3000) if i % 10], "src long, dst long").repartition(7)
    want = {(i, (i - 1) // 10 * 10 + 1) for i in range(1, 3001) if i % 10 != 1}
    files, held = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: files.append((out := held(df, label)).inputFiles()) or out)
    monkeypatch.setattr(components, "partitions", lambda _: 200)
    for least, most in ((1024, 3), (1, 200)):
        monkeypatch.setattr(components, "LEAST_LINKS", least)
        files.clear()
        assert {tuple(r) for r in connected_components(links).collect()} == want
        assert all(len(f) <= most for f in files[1:])


def test_no_document_goes_without_a_link(spark):
    """On the given documents: whoever goes is in a class of links of 0.8 or more, and nine in ten of those that should go do."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sets = {i: slow_set(t) for i, t in docs.items()}
    root = slow_classes(sets, lambda a, b: len(a) * 5 >= len(b) * 4 and len(b) * 5 >= len(a) * 4 and slow_similar(a, b))
    stay = {r.doc_id for r in one_of_each(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    should = {i for i, c in root.items() if i != c}
    gone = set(docs) - stay
    assert gone <= should and len(gone) >= 0.9 * len(should) > 0


def test_candidates_of_long_lists(spark):
    words = [f"word{i * i % 997}" for i in range(600)]
    fps = {i: slow_wide(edited(words, 60 + 7 * i, f"y{i}_")) for i in range(40)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, *map(signed, f)) for i, f in fps.items()], "node long, w0 long, w1 long, w2 long, w3 long")
    want = slow_classes(fps, slow_wide_link)
    for limit in (1 << 14, 2):
        pairs = wide_candidates(frame, limit).collect()
        assert all(r.src < r.dst and slow_wide_link(fps[r.src], fps[r.dst]) for r in pairs)
        assert all(r.bits == sum((x ^ y).bit_count() for x, y in zip(fps[r.src], fps[r.dst])) for r in pairs)
        roots = {r.node: r.root for r in connected_components(spark.createDataFrame([(r.src, r.dst) for r in pairs], "src long, dst long")).collect()}
        assert {i: roots.get(i, i) for i in fps} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 100)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100), (200, 100)}


def test_empty_and_null(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a"), (4, "a"), (4, "a")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 4), (False, 4), (True, 4)]


def test_one_of_each(spark):
    schema = "text string, doc_id long, component_id int"
    plain = spark.createDataFrame([("a b", 3, 1), ("A b", 2, 2), ("", 9, 3), (None, 8, 4), ("q", 1, 5)], schema)
    assert sorted(r.doc_id for r in one_of_each(plain).collect()) == [1, 2, 8] and one_of_each(plain).columns == plain.columns
    odd = spark.createDataFrame([("a b", 3, 1), ("a b", 3, 1), ("q", 3, 2), ("q", None, 3), ("z", None, 4)], schema)
    assert sorted(str(tuple(r)) for r in one_of_each(odd).collect()) == sorted(map(str, [("a b", 3, 1), ("q", None, 3), ("z", None, 4)]))
    assert one_of_each(plain.limit(0)).count() == 0
