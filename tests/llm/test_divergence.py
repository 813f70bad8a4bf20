import random
import re
from collections import Counter

import pytest

from tidemill.llm import divergence as D


def slow(rows, least=30, top=50, prior=5, unit=10**9):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(l or "", s or "", [lower(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x or "")]) for l, s, x in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen, counts, total = Counter(), {}, Counter()
        for _, source, terms in mine:
            seen.update(set(terms))
            counts.setdefault(source, Counter()).update(terms)
            total.update(terms)
        kept = sorted(t for t in seen if seen[t] >= least)
        p = lambda c: {t: 1 + unit * (c[t] + prior) // (sum(c[u] for u in kept) + prior * len(kept)) for t in kept}  # noqa: B023, E731
        by, q = {s: p(c) for s, c in counts.items()}, p(total)
        for s in by:
            pairs = sorted((-sum(abs(by[s][t] - by[o][t]) for t in kept), o.encode(), o) for o in by if o != s)
            out += [(lang, s, "pair", o, -v, n + 1) for n, (v, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - by[s][t], t.encode(), t) for t in kept if counts[s][t] > 0 and by[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, n + 1) for n, (v, _, t) in enumerate(terms)]
    return sorted(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "lang string, source string, text string, term string, n int")
    return sorted(map(tuple, D.audit(frame.repartition(4), **more).collect()))


def made(n, seed=0):
    rnd = random.Random(seed)
    words = ["the", "The", "THE", "été", "ÉTÉ", "x_y", "don't", "ﬁn", "😀a", "ß", *[f"w{c}" for c in "abcdefghijklmnop"], *map(chr, range(0x61, 0x7B))]
    lang = lambda: rnd.choice(["en", "en", "en", "fr", "", None])
    source = lambda: rnd.choice(["hot"] * 6 + ["b", "é", "", None, "z"])
    return [(lang(), source(), " ".join(rnd.choices(words[: rnd.randint(3, len(words))], k=rnd.randint(0, 25)))) for _ in range(n)]


@pytest.mark.parametrize("top, least", [(50, 5), (3, 5), (1, 1), (50, 10**6)])
def test_against_brute_force(spark, top, least):
    rows = made(300) + [("en", "b", None), ("en", "b", ""), ("one", "alone", "word " * 40), ("none", "q", "123 _ 4"), ("none", "r", None)]
    rows += [("en", "hot", "copy of a row")] * 40 + [("long", "s", "longword" * 20_000 + " b" * 50_000), ("long", "t", "b")]
    assert run(spark, rows, top=top, least_docs=least) == slow(rows, least, top)


def test_ties_across_the_limit(spark):
    rows = [("l", "s", " ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(6))), ("l", "u", "other other")]
    assert run(spark, rows, top=50, least_docs=1) == slow(rows, 1, 50)


def test_counts_are_given_out_in_portions(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 10)
    rows = made(120, 3)
    assert run(spark, rows, least_docs=4) == slow(rows, 4)


def test_no_rows(spark):
    assert run(spark, []) == []
