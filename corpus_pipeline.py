"""From documents to training sequences: four stages, each by one operator of ``tidemill.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import gam, packing, simhash, suffix_dedup
from tidemill.llm.bpe import VOCABULARY
from tidemill.llm.common import discarding, fresh_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels that aren't held out, doesn't reject.

    Null and empty texts are scored like any; very long ones are read whole; repeated rows fare alike.  Without a label
    all score one half and stay.
    """
    return gam.keep_good(docs, gam.fit_quality(docs, table(spark, sf_dir, "labels")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each class of near copies (shingles of five words, similarity of 0.8 or more).

    Null texts and texts without words are one class.  Rows with a repeated or null doc_id are ordered by (doc_id,
    text), null first, and the first of a class stays.  Very long texts are fingerprinted whole.
    """
    return simhash.one_of_each(docs)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte passages that start earlier in the corpus.

    Every row stays, even if nothing is left of its text; null becomes empty; of equal rows the later ones are emptied,
    unless they are shorter than a passage.  Very long texts are cut whole.
    """
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, each a sequence of a power-of-two length.

    Null and empty texts give one piece with the end token alone; very long texts give many; repeated rows repeat.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_copies", no_near_copies),
    ("repeated_passages", no_repeated_passages),
    ("packing", packed),
]

#: No SQL: a fitted model, components and a tokenizer.  tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again.

    What a stage itself wrote on its way is deleted when its rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with discarding(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
