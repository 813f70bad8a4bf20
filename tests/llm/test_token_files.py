import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemill.llm import bytebpe
from tidemill.llm import token_files as T
from tidemill.llm.common import fresh_path

PATH = public_tokenizers.path(T.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow(library, rows):
    """What the query returns, with rows of (doc_id, text) in the order of the files."""
    out, at = [], 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, T.END_ID]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def images(spark, path):
    return [bytes(r.content) for r in spark.read.format("binaryFile").load(path).orderBy("path").collect()]


def test_all_documents(spark, sf, library):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(map(tuple, T.op12(spark, sf).collect())) == slow(library, rows)


ODD = [(7, None), (7, ""), (7, None), (3, "a b"), (3, "a b"), (9, "x<|endoftext|>y"), (None, "nameless"), (None, None), (-5, "tail \n\n "), (12, "word, " * 70_000 + "end."), (T.LOWEST, "lowest")]


def test_odd_rows(spark, library, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 64)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, frames string, part int").repartition(3)
    path = fresh_path(spark, "t")
    T.write_token_files(frame, PATH, path)
    read = T.read_token_files(spark, path).cache()
    got = T.with_global_starts(read).collect()
    show = lambda rows: sorted((str(d), n, crc) for d, _, n, crc in rows)
    assert show(map(tuple, got)) == show(slow(library, ODD))
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == [sum(x.n_tokens for x in order[:i]) for i in range(len(order))]
    ids = [T.LOWEST if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    assert max(len(T.TokenFile(x).entries) for x in images(spark, path)) > 3  # the long text has several frames
    decoded = {r.doc_id: library.decode(r.ids[:-1], skip_special_tokens=False) for r in read.collect()}
    assert decoded[12] == ODD[9][1] and decoded[9] == ODD[5][1] and decoded[-5] == ODD[8][1]


def test_no_rows(spark):
    path = fresh_path(spark, "t")
    T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert T.with_global_starts(T.read_token_files(spark, path, ids=False)).collect() == []


def test_only_requested_frames_are_read(spark, library):
    rows = [(i, f"document {i} " * (i + 1)) for i in range(30)]
    path, other = fresh_path(spark, "t"), fresh_path(spark, "t")
    T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, path)
    files = images(spark, path)
    place = next((k, i) for k, x in enumerate(files) for i, d in enumerate(T.TokenFile(x).documents) if d["doc_id"] == 11)
    torn = bytearray(files[place[0]])
    torn[T.TokenFile(files[place[0]]).places[place[1]] + 9] ^= 255
    with pytest.raises(ValueError, match="frame"):
        T.TokenFile(bytes(torn)).ids(place[1])
    files[place[0]] = bytes(torn)
    raw = spark.createDataFrame([(bytes(x[:-4]),) for x in files], "value binary").selectExpr("cast(value as string) as value")
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", (b"\xb1\xea\x92\x8f").decode("latin-1")).option("maxRecordsPerFile", 1).text(other)
    assert sorted(images(spark, other)) == sorted(files)
    wanted = [2, 29, 10, 999]
    got = {r.doc_id: library.decode(r.ids[:-1]) for r in T.read_token_files(spark, other, wanted).collect()}
    assert got == {i: rows[i][1] for i in wanted[:3]}
    with pytest.raises(Exception, match="frame"):
        T.read_token_files(spark, other).collect()


def test_a_file_is_a_plain_zstandard_stream(spark, library):
    rows = [(i, f"text {i}") for i in range(20)]
    path = fresh_path(spark, "t")
    T.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, path)
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(x), read_across_frames=True).read() for x in images(spark, path))
    assert np.frombuffer(whole, "<u2").tolist() == [i for _, t in rows for i in [*library.encode(t, add_special_tokens=False).ids, 0]]


@pytest.mark.parametrize("data", [b"", b"12345678", b"\0" * 40, b"\0" * 36 + b"\xb1\xea\x92\x8f"])
def test_foreign_files(data):
    with pytest.raises(ValueError):
        T.TokenFile(data)


def test_ranges_are_in_order():
    rnd = random.Random(2)
    begins, times = np.array([-3, 0, 5, 9]), np.array([1, 4, 1, 2])
    limits = (begins, times, np.concatenate(([0], times.cumsum()[:-1])))
    keys = sorted((rnd.randint(-9, 12), rnd.getrandbits(64)) for _ in range(3000))
    part = T.range_of(np.array([k for k, _ in keys]), np.array([h for _, h in keys], np.uint64), *limits)
    assert (np.diff(part) >= 0).all() and set(part.tolist()) == set(range(8))


def test_memory_gives_what_the_library_gives(library, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMORY", 2000)
    rnd, bpe = random.Random(1), bytebpe.ByteBpe(PATH)
    abc = [*"ab 1'st?,.\n\t\0\x0b\x1c\x85\xa0 ᠎ 　​İéß×÷µ²ſƀ中😀", "  ", "   ", "<|endoftext|>", "'re", " 's", "\n\n", "word", " word,", ".\nNext"]
    texts = ["".join(rnd.choice(abc) for _ in range(rnd.randint(0, 30))) for _ in range(15_000)] + [f"a{chr(c)} b {chr(c)}d  {chr(c)}" for c in [*range(0xD800), *range(0xE000, 0x10000)]]
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        assert [np.frombuffer(x, "<u2").tolist() for x in bpe.ids(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
