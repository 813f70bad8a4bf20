"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.sources.scratch import discarding, fresh_path, materialise

__all__ = ["discarding", "fresh_path", "materialise", "partitions", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
