import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tidemill.llm import packing, wordbpe
from tidemill.llm.packing import binary_lengths, pack
from tidemill.llm.bpe import VOCABULARY, encode, encode_digests
from tidemill.llm.token_counts import LongestMatch, op3, token_counts

PATH = public_tokenizers.path(VOCABULARY)
ODD = [None, "", "  \n", "Don't I'LL 's", "a<|endoftext|>B<|ENDOFTEXT|>", "ΣΑΣ İ ẞ ﬁ １２ ½", "日本語 🎉 नमस्ते", "\x1c x\x85y ", "x" * 5000, "ab " * 9000, "֌՘"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_encoder_equals_library(library):
    rnd = random.Random(5)
    pool = [chr(c) for c in [*range(0x250), *range(0x370, 0x600), *range(0x2000, 0x2070), *range(0x1F600, 0x1F620)]]
    texts = [t or "" for t in ODD] + ["".join(rnd.choices(pool, k=50)) for _ in range(500)]
    bpe = wordbpe.load(PATH)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(text) == want.ids
        assert bpe.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_long_and_short_merges_agree():
    bpe, rnd = wordbpe.load(PATH), random.Random(3)
    for _ in range(300):
        part = rnd.choices("abcdeinthrs", k=rnd.randint(1, 60))
        assert bpe._merge_short([*part]) == bpe._merge_long([*part])


def test_digests(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1 - i, t) for i, t in enumerate(ODD)] + [(-1, None), (None, "x")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(str, map(tuple, encode_digests(frame, PATH).collect()))) == sorted(map(str, want))
    assert encode_digests(frame.limit(0), PATH).count() == 0
    full = encode(frame, PATH).collect()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in full)


def test_packing(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(-1 - i, t) for i, t in enumerate(ODD)]
    got = packing.pack(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int"), PATH, with_ids=True).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length == 1 << r.bucket <= 4096 for r in got)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len(pieces) == len(rows)
    for i, t in rows:
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.ids == part and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_repeated_rows_are_packed_as_often_as_they_occur(spark, library):
    rows = [(1, "a few words here"), (1, "a few words here"), (None, "a few words here"), (2, None), (2, None), (3, "word " * 9000)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect()
    want = Counter()
    for i, t in rows:
        n, at = len(library.encode(t or "", add_special_tokens=False).ids) + 1, 0
        for length in binary_lengths(n):
            want[i, at, length, n] += 1
            at += length
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(got)


def test_buckets_round_trip(spark, sf, tmp_path):
    packing.write_buckets(packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH, with_ids=True), str(tmp_path / "b"))
    assert {len(r.ids) == 1 << r.bucket for r in spark.read.parquet(str(tmp_path / "b")).collect()} == {True}


def test_binary_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 100_000):
        cut = packing.binary_lengths(n)
        assert sum(cut) == n and all(c & (c - 1) == 0 and c <= 4096 for c in cut) and cut == sorted(cut, reverse=True)
    with pytest.raises(ValueError):
        packing.pack(None, PATH, longest=3000)


def greedy(word, first, inner):
    n, at = 0, 0
    while at < len(word):
        use = first if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in use), None)
        if end is None:
            return 0
        n, at = n + 1, end
    return n


def test_longest_match_equals_greedy():
    rnd = random.Random(9)
    for _ in range(200):
        make = lambda: {"".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(rnd.randint(1, 14))}
        first, inner = make(), make()
        match = LongestMatch(first, inner)
        for _ in range(60):
            word = "".join(rnd.choices("abc", k=rnd.randint(0, 12)))
            assert match.count(word) == greedy(word, first, inner), (word, first, inner)


def test_token_counts(spark):
    bpe = wordbpe.load(PATH)
    pieces = {t.removesuffix("</w>") for t in bpe.vocab}
    rows = list(enumerate(ODD)) + [(3, ODD[3])]
    got = token_counts(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_words int"), PATH).collect()
    want = []
    for i, t in rows:
        words = [w for c in bpe.chunks(t or "") for w in bpe.shown_words(c)]
        want.append((i, len(words), sum(greedy(w, pieces, pieces) for w in words if len(w) < 3000) + sum(match_long(w, pieces) for w in words if len(w) >= 3000), 0))
    assert sorted(map(tuple, got)) == sorted(want)


def test_token_counts_of_documents(spark, sf):
    bpe = wordbpe.load(PATH)
    pieces, known, want = {t.removesuffix("</w>") for t in bpe.vocab}, {}, []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.collect():
        words = [w for c in bpe.chunks(r.text or "") for w in bpe.shown_words(c)]
        for w in {*words} - {*known}:
            known[w] = match_long(w, pieces)
        want.append((r.doc_id, len(words), sum(known[w] for w in words), 0))
    assert sorted(map(tuple, op3(spark, sf).collect())) == sorted(want)
    assert token_counts(docs.limit(0), PATH).count() == 0


def match_long(word, pieces):
    n, at, longest = 0, 0, max(map(len, pieces))
    while at < len(word):
        at = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in pieces)
        n += 1
    return n
