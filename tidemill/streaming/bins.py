"""Regular bins from a stream of readings: a bin is given out once, when it is over and late rows are waited for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_bins(rows: DataFrame, keys: Sequence[str], late: str = "1 hour", width: str = "15 minutes") -> DataFrame:
    """(keys, bin_start, n, mean) for rows (keys, ts, value); in append mode a bin comes when the watermark passes its end.

    Rows later than ``late`` are dropped by the watermark, which Spark counts in the query's progress.
    """
    by = rows.withWatermark("ts", late).groupBy(*keys, F.window("ts", width).alias("w"))
    return by.agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(*keys, F.col("w.start").alias("bin_start"), "n", "mean")
