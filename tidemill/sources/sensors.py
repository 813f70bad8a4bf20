"""Readers of raw sensor files and of saved scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sensor_csv(spark: SparkSession, path: str, sensors: Sequence[str], time_zone: str = "UTC", schema: str | None = None) -> DataFrame:
    """(date, sensors): the first column is the time whatever its name; rows without a time are dropped, values that
    are no numbers are null; times are read as UTC and shown in ``time_zone``.  Only the named sensors are kept.

    ``schema`` (all columns as strings) spares the look at the file's header.
    """
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.csv(path)
    raw = raw.toDF("date", *[c.lstrip("﻿") for c in raw.columns[1:]])
    when = F.try_to_timestamp("date")
    local = when if time_zone == "UTC" else F.from_utc_timestamp(when, time_zone)
    rows = raw.select(local.cast("timestamp_ntz").alias("date"), *(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in sensors))
    return rows.where("date is not null")


def to_long(df: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """(ids, sensor, value) of the values that aren't null."""
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in sensors)).unpivot(list(ids), list(sensors), "sensor", "value").where("value is not null")


def to_wide(df: DataFrame, ids: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """The other way round; several values of a sensor become their mean."""
    return df.groupBy(*ids).pivot("sensor", list(sensors)).agg(F.avg("value"))


def read_scores(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A saved forecast export: a folder of Parquet, or CSV with a header (a byte order mark is ignored)."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)
    return spark.read.schema(schema).parquet(path)
