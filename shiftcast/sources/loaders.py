"""Calls, e-mail and outbound files to hourly workload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import hour_floor
from . import files

EMPTY = "task string, ts timestamp_ntz, volume double"


def _records(
    spark: SparkSession, base: str, pattern: str, task: Column, roles: dict[str, tuple[str, ...]], defaults: dict[str, str]
) -> list[DataFrame]:
    """``(task, ts, value)`` of the files of a kind, none without such files; one scan reads them."""
    paths = files.matching_paths(spark, base, pattern)
    if not paths:
        return []
    rows = files.read_roles(spark, paths, {"ts": files.TIMESTAMP_NAMES, **roles}, defaults)
    return [rows.select(task.alias("task"), files.parsed("ts").alias("ts"), F.col("value").try_cast("double").alias("value"))]


def _counted(spark: SparkSession, base: str, pattern: str, task: str, names: tuple[str, ...]) -> list[DataFrame]:
    """The value column, or 1 per record where there is none."""
    return _records(spark, base, pattern, F.lit(task), {"value": names}, {"value": "1"})


def _outbound(spark: SparkSession, base: str, pattern: str) -> list[DataFrame]:
    task = F.concat(F.lit("outbound_"), F.lower(F.trim("kind")))
    roles = {"kind": files.TYPE_NAMES, "value": files.OUTBOUND_COUNT_NAMES}
    return _records(spark, base, pattern, task, roles, {"kind": "unknown", "value": "1"})


def _hourly(spark: SparkSession, records: list[DataFrame]) -> DataFrame:
    """One union and one aggregation however many files there are."""
    if not records:
        return spark.createDataFrame([], EMPTY)
    rows = reduce(DataFrame.unionByName, records).na.drop(subset=["task", "ts"])
    return rows.groupBy("task", hour_floor("ts").alias("ts")).agg(
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("volume")
    )


def load_calls(spark: SparkSession, base: str, pattern: str = "*call*.csv") -> DataFrame:
    return _hourly(spark, _counted(spark, base, pattern, "calls", files.CALL_NAMES))


def load_emails(spark: SparkSession, base: str, pattern: str = "*email*.csv") -> DataFrame:
    return _hourly(spark, _counted(spark, base, pattern, "emails", files.EMAIL_NAMES))


def load_outbound(spark: SparkSession, base: str, pattern: str = "*outbound*.csv") -> DataFrame:
    """Hourly volume per outbound type; rows without a type value are dropped, a
    missing type column counts as ``outbound_unknown``."""
    return _hourly(spark, _outbound(spark, base, pattern))


def load_all(spark: SparkSession, base: str) -> DataFrame:
    """The three kinds of files in one hourly table; kinds without files are absent."""
    records = [
        *_counted(spark, base, "*call*.csv", "calls", files.CALL_NAMES),
        *_counted(spark, base, "*email*.csv", "emails", files.EMAIL_NAMES),
        *_outbound(spark, base, "*outbound*.csv"),
    ]
    return _hourly(spark, records)
