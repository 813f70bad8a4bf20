"""Checks that report (check, violations) instead of stopping; ``require`` stops."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemill.sources.scratch import discard


def report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Counts of rows that break each rule, in one pass.  A rule is a condition that must hold; null breaks it."""
    one = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return one.unpivot([], list(rules), "check", "violations")


def require(checked: DataFrame) -> None:
    """ValueError with the checks that found violations."""
    bad = checked.where("violations > 0").collect()  # a row for each rule
    if bad:
        raise ValueError("; ".join(f"{r.check}: {r.violations}" for r in bad))


def validate_forecast(df: DataFrame, keys: Sequence[str] = ("entity_id", "model", "anchor_pos"), horizon: int = 96) -> DataFrame:
    """Scores in range, labels 0 or 1, targets that follow their anchor, and complete horizons of unique steps."""
    rules = {
        "score_in_unit_interval": F.col("p").between(0, 1),
        "label_is_binary": F.col("empty").isin(0, 1),
        "target_follows_anchor": F.col("target_pos") == F.col("anchor_pos") + F.col("step"),
        "step_in_horizon": F.col("step").between(1, horizon),
    }
    rows = report(df, rules)
    by = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("step").alias("d"))
    return rows.unionByName(report(by, {"complete_horizon": F.col("n") == horizon, "unique_steps": F.col("n") == F.col("d")}))


def unique_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = df.groupBy(*keys).count()
    return report(by, {"unique_" + "_".join(keys): F.col("count") == 1})


def disjoint_splits(anchors: DataFrame, first: str = "val", second: str = "test") -> DataFrame:
    """(entity_id, last_first, first_second, ok): whether all targets of one split end before the other's begin."""
    out = anchors.groupBy("entity_id").agg(F.max(F.when(F.col("split") == first, F.col("pos") + 96)).alias("last_first"), F.min(F.when(F.col("split") == second, F.col("pos") + 1)).alias("first_second"))
    return out.withColumn("ok", (F.col("last_first") < F.col("first_second")).cast("int"))


def alignment(one: DataFrame, other: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-7) -> DataFrame:
    """(matched, only_left, only_right, max_delta, ok) of two exports of the same scores."""
    a, b = one.select(*keys, F.col(value).alias("_a")), other.select(*keys, F.col(value).alias("_b"))
    both = a.join(b, list(keys), "full")
    out = both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0.0)).alias("max_delta"))
    return out.withColumn("ok", ((F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("max_delta") <= tolerance)).cast("int"))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that stops the query if a key is there twice on either side."""
    n = F.count("*").over(Window.partitionBy(*keys))
    stop = F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*keys))))
    single = lambda df: df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, stop).otherwise(F.col("_n"))).where("_n = 1").drop("_n")
    return single(left).join(single(right), list(keys))


def join_coverage(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], limit: float = 0.01) -> DataFrame:
    """(targets, unmatched, duplicate_keys, ok): share of rows without a match, and keys that ``lookup`` has more than once.

    ``ok`` is 0 if more than ``limit`` of the rows lack a match or any key is repeated.
    """
    by = lookup.groupBy(*keys).count()
    there = rows.select(*keys).join(by.select(*keys, F.lit(1).alias("_hit")), list(keys), "left")
    share = there.agg(F.count("*").alias("targets"), F.coalesce(F.avg(F.col("_hit").isNull().cast("double")), F.lit(0.0)).alias("unmatched"))
    twice = by.agg(F.count_if(F.col("count") > 1).alias("duplicate_keys"))
    return share.join(F.broadcast(twice)).withColumn("ok", ((F.col("unmatched") <= limit) & (F.col("duplicate_keys") == 0)).cast("int"))


def matched_export(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], write: Callable[[DataFrame, str], None], path: str, limit: float = 0.01) -> dict[str, int]:
    """Write ``rows`` with what ``lookup`` says of them, or stop: {targets, unmatched, duplicate_keys}, counted by the writing job itself.

    ValueError, and nothing is left at ``path``, if more than ``limit`` of the rows lack a match or any meets a key that
    ``lookup`` has twice.  ``write(frame, path)`` must write the whole frame once, as a sink does; a null key matches nothing.
    """
    more = [c for c in lookup.columns if c not in keys]
    by = lookup.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in more))
    seen = Observation()
    joined = rows.join(by, list(keys), "left").observe(
        seen, F.count("*").alias("targets"), F.count_if(F.col("_n").isNull()).alias("unmatched"), F.count_if(F.col("_n") > 1).alias("twice"),
    )
    spark = rows.sparkSession
    try:
        write(joined.drop("_n"), path)
        found = seen.get
        if found["unmatched"] > limit * found["targets"] or found["twice"]:
            raise ValueError(f"{found['unmatched']} of {found['targets']} rows have no match, {found['twice']} meet a repeated key")
    except BaseException:
        discard(spark, path)
        raise
    return {"targets": found["targets"], "unmatched": found["unmatched"], "duplicate_keys": found["twice"]}


def selection_rows(df: DataFrame, keys: Sequence[str], allowed: str = "val") -> DataFrame:
    """(keys, rows, other_rows, test_columns): what a selection would see that it mustn't."""
    named = sum("test" in c.lower() for c in df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(F.col("split") != allowed).alias("other_rows"), F.lit(named).alias("test_columns"))


def reconcile(observed: DataFrame, expected: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """(keys, counts, status): observed counts, and whether they are the expected ones; a key on one side only fails."""
    a = observed.select(*keys, *counts)
    b = expected.select(*keys, *(F.col(c).alias(f"_{c}") for c in counts))
    same = F.lit(True)
    for c in counts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, list(keys), "full").select(*keys, *counts, F.when(same, "pass").otherwise("fail").alias("status"))
