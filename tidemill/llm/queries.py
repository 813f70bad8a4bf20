"""Queries over the operators of this subpackage; SQL where DuckDB can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemill.llm import bpe, centroids, divergence, gam, improbable, packing, simhash, suffix_dedup, token_counts, token_files, topk, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_markov_url_ratio": url_filter.op1,
    "op2_suffix_interval_dedup": suffix_dedup.op2,
    "op3_linear_wordpiece_counts": token_counts.op3,
    "op4_improbable_feature_digest": improbable.op4,
    "op5_binary_packing": packing.op5,
    "op6_forced_boundary_bpe": bpe.op6,
    "op7_simhash_byte_index": simhash.op7,
    "op8_pairwise_gam_quality": gam.op8,
    "op9_pivot_distance_topk": topk.op9,
    "op10_arc_to_warc": warc.op10,
    "op11_vantage_centroids": centroids.op11,
    "op12_seekable_token_files": token_files.op12,
    "op13_count_cell_audit": divergence.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_suffix_interval_dedup": suffix_dedup.ORACLE,
    "op9_pivot_distance_topk": topk.ORACLE,
    "op10_arc_to_warc": warc.ORACLE,
    "op11_vantage_centroids": centroids.ORACLE,
    "op13_count_cell_audit": divergence.ORACLE,
}
