"""Column functions of the engine.  All are expressions of built-in functions and stay within code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scores are kept off 0 and 1 by this much before logarithms.
EPSILON = 1e-6
INTERVAL_HOURS = 0.25
#: Coefficients of the meters (hvac, lighting, plugs, total) under six accounting assumptions.
LOAD_ASSUMPTIONS = (
    ("hvac_lighting_full_metered", 1.0, 1.0, 0.0, 0.0),
    ("hvac_lighting_conservative", 0.3, 0.8, 0.0, 0.0),
    ("lighting_only_full", 0.0, 1.0, 0.0, 0.0),
    ("hvac_only_conservative", 0.3, 0.0, 0.0, 0.0),
    ("hvac_lighting_plug_conservative", 0.3, 0.8, 0.1, 0.0),
    ("total_south_30pct", 0.0, 0.0, 0.0, 0.3),
)
#: Names that ``time_features`` gives.
TIME_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_weekend", "is_business_hour")
CONTROL_SCENARIOS = (("full", 1.0), ("half", 0.5), ("quarter", 0.25))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_sum_min1(*cols: str | Column) -> Column:
    """Sum over columns; null only if all are null."""
    parts = [col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def row_mean_skipna(*cols: str | Column) -> Column:
    """Mean over the columns that aren't null; null if all are."""
    parts = [col(c) for c in cols]
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in parts])
    return F.when(n > 0, total / n)


def occupied_label(count: str | Column, cut: str | Column) -> Column:
    """1 if the count is above the cut, else 0; a null count is not above it."""
    return F.coalesce((col(count) > col(cut)).cast("int"), F.lit(0))


def clip_score(p: str | Column) -> Column:
    return F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), col(p)))


def interval_kwh(kw: str | Column, hours: float = INTERVAL_HOURS) -> Column:
    """Energy of one interval; null power counts as 0, negative sums as 0."""
    return F.greatest(F.coalesce(col(kw), F.lit(0.0)), F.lit(0.0)) * hours


def slot_index(ts: str | Column) -> Column:
    """Quarter hour of the week, Monday 00:00 first: 0 to 671."""
    t = col(ts)
    return (F.weekday(t) * 96 + F.hour(t) * 4 + F.floor(F.minute(t) / 15)).cast("int")


def week_floor(ts: str | Column) -> Column:
    """Monday 00:00 of the week, without a time zone."""
    return F.date_trunc("week", col(ts)).cast("timestamp_ntz")


def time_features(ts: str | Column, business: bool = True) -> dict[str, Column]:
    """Calendar numbers: circles for hour, weekday and month, weekend and (Monday to Friday, 7 to 19) business hour."""
    t = col(ts)
    hour, dow, month = F.hour(t) + F.minute(t) / 60, F.weekday(t), F.month(t) - 1
    circle = lambda x, n: (F.sin(2 * F.pi() * x / n), F.cos(2 * F.pi() * x / n))
    out = {}
    for name, x, n in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = circle(x, n)
    out["is_weekend"] = (dow >= 5).cast("double")
    if business:
        out["is_business_hour"] = ((dow < 5) & (F.hour(t) >= 7) & (F.hour(t) < 19)).cast("double")
    return out


def us_holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(day) of United States federal holidays, as observed, of some years: a small dimension made by rule."""
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    fixed = F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))])
    shifted = F.transform(fixed, lambda d: F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d))

    def nth(month: int, weekday: int, n: int) -> Column:
        one = F.make_date("y", F.lit(month), F.lit(1))
        return F.date_add(one, F.pmod(F.lit(weekday) - F.weekday(one), F.lit(7)) + 7 * (n - 1))

    may = F.make_date("y", F.lit(5), F.lit(31))
    moving = F.array(nth(1, 0, 3), nth(2, 0, 3), F.date_sub(may, F.weekday(may)), nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4))
    return years.select(F.explode(F.concat(shifted, moving)).alias("day")).distinct()


def is_midnight(ts: str | Column) -> Column:
    t = col(ts)
    return (F.hour(t) == 0) & (F.minute(t) == 0)


def bin_bounds(start: str | Column, step: str | Column | None = None) -> dict[str, Column]:
    """End of a bin, when it is usable, and (with a step) the target bin's bounds."""
    t = col(start)
    out = {"bin_end": t + F.expr("interval 15 minutes"), "issue_time": t + F.expr("interval 15 minutes")}
    if step is not None:
        ahead = F.make_interval(mins=15 * col(step))
        out |= {"target_start": t + ahead, "target_end": t + ahead + F.expr("interval 15 minutes")}
    return out


def slugify(name: str | Column) -> Column:
    """Lower case, everything but letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def percent_label(share: str | Column) -> Column:
    return F.concat(F.round(100 * col(share)).cast("int").cast("string"), F.lit("%"))


def near_equal(a: str | Column, b: str | Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether a lies within ``absolute`` plus ``relative`` of b's size of b; null if either is null."""
    return F.abs(col(a) - col(b)) <= absolute + relative * F.abs(col(b))


def convex_blend(parts: dict[str, float], clip: bool = True) -> Column:
    """Weighted sum of score columns.  ValueError: a negative weight, or weights that don't sum to one."""
    if any(w < 0 for w in parts.values()) or abs(sum(parts.values()) - 1) > 1e-12:
        raise ValueError("weights must be non-negative and sum to one")
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in parts.items()])
    return clip_score(total) if clip else total
