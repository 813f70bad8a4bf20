"""Registration of queries with their SQL.

Doubles are rounded to six places in both engines, after NUDGE is added: values that lie midway between two such
numbers, as means of few decimals often do, then round alike whatever order the engine added in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.scratch import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


NUDGE = 1.3e-9
#: Tables that queries of one process share, if a caller puts a dictionary here (tests do); else each writes its own.
TABLES: dict | None = None


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(c) + NUDGE, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a function of (spark, sf_dir).  ``doubles``: columns that the SQL is to round."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with shared(TABLES):
                return rounded(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            cols = ", ".join(f"round({c}::DOUBLE + {NUDGE}, 6) AS {c}" for c in doubles.split())
            ORACLES[name] = f"SELECT * REPLACE ({cols}) FROM (\n{sql}\n)" if cols else sql
        return f

    return keep
