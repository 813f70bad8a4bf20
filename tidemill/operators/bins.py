"""From irregular readings to regular bins for each entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.scalar import occupied_label
from tidemill.operators.chunks import CHUNK, with_halo


def bin_of(ts: str | Column = "ts", width: str = "15 minutes") -> Column:
    """Left label of the left-closed bin that a time lies in."""
    return F.window(ts, width).getField("start")


def resample(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], ts: str = "ts") -> DataFrame:
    """One row for each key and bin that has readings."""
    return df.groupBy(*keys, bin_of(ts).alias("bin_start")).agg(*(c.alias(n) for n, c in aggs.items()))


def resample_mean(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts") -> DataFrame:
    return resample(df, keys, {value: F.avg(value)}, ts)


def resample_label(df: DataFrame, keys: Sequence[str], count: str, cut: float = 0.0, ts: str = "ts") -> DataFrame:
    """Mean and largest count of each bin, and its label; bins without a count are left out."""
    out = resample(df, keys, {"count_mean": F.avg(count), "count_max": F.max(count)}, ts).where("count_mean is not null")
    occupied = occupied_label("count_max", F.lit(cut))
    return out.withColumns({"occupied": occupied, "empty": 1 - occupied})


def bin_spine(df: DataFrame, keys: Sequence[str], width: str = "15 minutes") -> DataFrame:
    """All bins from the first to the last of each key, numbered from 0 without a sort: (keys, bin_start, pos)."""
    ends = df.groupBy(*keys).agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    return ends.select(*keys, F.posexplode(F.expr(f"sequence(lo, hi, interval {width})")).alias("pos", "bin_start")).select(*keys, "bin_start", F.col("pos").cast("long").alias("pos"))


def align(spine: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sources brought onto the bin axis; what they lack is null."""
    for s in sources:
        spine = spine.join(s, [*keys, "bin_start"], "left")
    return spine


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: str = "pos", lead: float = 0.0) -> DataFrame:
    """Each null becomes the last value before it, leading ones ``lead``.  Other columns stay as they are.

    One window for all columns.  A single very long series runs in one task; ``forward_fill_chunked`` splits it.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(lead)) for c in cols})


def forward_fill_chunked(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: str = "pos", lead: float = 0.0, chunk: int = CHUNK) -> DataFrame:
    """The same for long series: within chunks in parallel, with each chunk's last value carried to the next ones."""
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    last = cut.groupBy(*keys, "_chunk").agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in cols))
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "_chunk", *(F.last(f"_{c}", ignorenulls=True).over(over).alias(f"_{c}") for c in cols))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = cut.join(carried, [*keys, "_chunk"], "left")
    return filled.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_{c}"), F.lit(lead)) for c in cols}).drop("_chunk", *(f"_{c}" for c in cols))


def missing_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, missing_rate), in one pass over the table."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols))
    return one.unpivot([], list(cols), "feature", "missing_rate")


def coverage_gate(df: DataFrame, cols: Sequence[str], least: float = 0.25) -> DataFrame:
    """(coverage, included): whether enough bins have any of the columns."""
    share = F.avg(F.coalesce(*cols).isNotNull().cast("double"))
    return df.agg(share.alias("coverage")).withColumn("included", (F.col("coverage") >= least).cast("int"))


def gated(df: DataFrame, cols: Sequence[str], least: float = 0.25) -> DataFrame:
    """``df`` with the columns null, and ``included`` 0, unless enough bins have any of them."""
    gate = F.broadcast(coverage_gate(df, cols, least).select("included"))  # one row
    return df.join(gate).withColumns({c: F.when(F.col("included") == 1, F.col(c)) for c in cols})


def future_explode(anchors: DataFrame, horizon: int = 96) -> DataFrame:
    """A row for each anchor and step; no shuffle."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return anchors.select("*", steps.alias("step")).withColumn("target_pos", F.col("pos") + F.col("step"))


def history_window(df: DataFrame, value: str, keys: Sequence[str], length: int = 96, chunk: int = CHUNK) -> DataFrame:
    """The last ``length`` values up to each bin as an array; shorter at the begin."""

    def within(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("pos").rowsBetween(-(length - 1), 0)
        return rows.withColumn("history", F.collect_list(value).over(w))

    return with_halo(df, keys, length - 1, within, chunk)
