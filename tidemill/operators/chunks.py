"""Windows over long series without one task a series: chunks of rows or time, with what a chunk needs of those before it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a chunk: 32 days of quarter hours.
CHUNK = 96 * 32


def with_halo(df: DataFrame, keys: Sequence[str], before: int, f: Callable[[DataFrame, list[str]], DataFrame], chunk: int = CHUNK, order: str = "pos") -> DataFrame:
    """``f(rows, keys of a chunk)`` on chunks of ``chunk`` positions, each with the ``before`` positions ahead of it.

    ``f`` may look back ``before`` rows in a window over the keys that it is given and must keep all rows and ``order``,
    whole numbers without gaps; the rows ahead are dropped again.  One shuffle; a row is copied
    ``before / chunk`` times on average, rounded up at most once more.
    """
    own = F.floor(F.col(order) / chunk)
    last = F.floor((F.col(order) + before) / chunk)
    copied = df.withColumn("_chunk", F.explode(F.sequence(own, last)))
    return f(copied, [*keys, "_chunk"]).where(F.col("_chunk") == own).drop("_chunk")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: dict[str, str], time: str = "ts", right_time: str = "ts", matched: str | None = None, tie: Sequence[str] = (), within: str | None = None, exact: bool = True, chunk: int = 86400) -> DataFrame:
    """``left`` with what the last row of ``right`` before it says: a left join of streams on clocks of their own.

    keys: columns of both sides; ``cols``: right column -> name in the result; ``matched``: name for the time of the row
    that was found.  Of right rows with equal times that with the greatest ``tie`` columns counts, and at any rate the
    same one.  Rows older than ``within`` (an interval such as '30 minutes') count as none; ``exact``: rows at the same
    time are seen.  Left rows with a null key or time, or without a match, get nulls; right ones with either are left out.

    Both sides meet once, by key and ``chunk`` seconds of time, and each chunk's last right row is carried to the chunks
    after it; so a long series is spread over many tasks, and no row of one side meets all of the other.
    """
    names = list(cols.values())
    said = F.struct(F.col(right_time).alias("_at"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)))
    known = right.where(F.col(right_time).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    side = F.lit(0 if exact else 2)
    heard = known.select(*keys, F.col(right_time).alias("_time"), side.alias("_side"), said.alias("_said"))
    own = left.select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = own.unionByName(heard, allowMissingColumns=True)
    both = both.withColumn("_chunk", F.floor(F.unix_micros(F.col("_time").cast("timestamp")) / (chunk * 1_000_000)))
    ends = both.groupBy(*keys, "_chunk").agg(F.max("_said").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_time", "_side", "_said").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_said", F.last("_said", ignorenulls=True).over(inside)).where("_row is not null")
    found = found.join(carried, [*keys, "_chunk"], "left").withColumn("_said", F.coalesce("_said", "_carried"))
    if within is not None:
        found = found.withColumn("_said", F.when(F.col("_said._at") >= F.col("_time") - F.expr(f"interval {within}"), F.col("_said")))
    shown = [F.col(f"_said._v{i}").alias(n) for i, n in enumerate(names)]
    return found.select("_row.*", *shown, *([F.col("_said._at").alias(matched)] if matched else []))
