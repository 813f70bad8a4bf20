import numpy as np
import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline as cp
from tidemill.llm import gam
from tidemill.llm.bpe import VOCABULARY

from .test_simhash import slow_near_classes


def slow_texts(rows, window=100):
    seen, out = set(), {}
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(b[s : s + window])
        out[i] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = gam.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r.doc_id: r.text for r in docs.collect() if model.score(np.array([gam.text_features((r.text or "").encode())]))[0] >= 0.3}
    got = cp.STAGES[0][1](spark, docs, sf)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == rows

    stay = {i for i, c in slow_near_classes(rows).items() if i == c}
    got = cp.STAGES[1][1](spark, got, sf)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == stay

    left = slow_texts([(i, rows[i]) for i in sorted(stay)])
    got = cp.STAGES[2][1](spark, got, sf)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == left
    assert all(r.n_chars == len(r.text) for r in got.collect())

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    got = cp.STAGES[3][1](spark, got, sf).collect()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    assert {r.doc_id: r.doc_tokens for r in got} == total and sum(r.length for r in got) == sum(total.values())
    assert cp.run(spark, sf).count() == len(got)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc int"
LONG = "".join(f"word{i} " for i in range(4000))
ODD = [(1, None, None, None, None, 1), (None, "a b c", "en", "x", 5, 2), (1, "", "en", "x", 0, 3), (1, "", "en", "x", 0, 3), (5, LONG, "en", "x", len(LONG), 4), (6, LONG, "en", "x", len(LONG), 5)]


def test_odd_documents(spark, sf):
    frame = spark.createDataFrame(ODD, SCHEMA)
    near = cp.STAGES[1][1](spark, frame, sf)
    # texts without words are one class, of which the first by (doc_id, text), null first, stays; so is each long text
    assert sorted((str(r.doc_id), len(r.text or ""), r.doc) for r in near.collect()) == [("1", 0, 1), ("5", len(LONG), 4), ("None", 5, 2)]
    whole = cp.STAGES[2][1](spark, frame, sf)
    assert sorted((str(r.doc_id), len(r.text or ""), r.doc) for r in whole.collect()) == [("1", 0, 1), ("1", 0, 3), ("1", 0, 3), ("5", len(LONG), 4), ("6", 0, 5), ("None", 5, 2)]
    packed = cp.STAGES[3][1](spark, near, sf).collect()
    assert {(r.doc_id, r.doc_tokens) for r in packed} >= {(1, 1)} and sum(r.length for r in packed) == sum({(r.doc_id): r.doc_tokens for r in packed}.values())
    good = cp.STAGES[0][1](spark, frame, sf)
    assert good.columns == frame.columns and {r.doc for r in good.collect()} <= {1, 2, 3, 4, 5}


def test_empty_documents(spark, sf):
    frame = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0
        assert name == "packing" or frame.columns == [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stage_names(name):
    assert name.isidentifier()
