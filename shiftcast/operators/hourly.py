"""From raw records to dense hourly series.

Raw records only ever meet hash aggregations with a map-side partial step, so a
site or task that holds a third of all records still reaches the shuffle as one
row per hour and map task. Every ordered operator of the package works on the
result, whose length per series is bounded by the hours of the time span.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOTAL_COLUMN, VOLUME_COLUMNS
from ..functions.clock import hours, hour_index

# The aggregates a caller may name.
AGGREGATES = {"sum", "mean", "count"}


def aggregate_hourly(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts",
    value: str | None = None,
    how: str = "sum",
    name: str = "volume",
) -> DataFrame:
    """Records per key and hour, or an aggregate of ``value``.

    A sum over nothing but NULLs is 0; records without a key value are dropped.
    """
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}")
    if value is None:
        measure: Column = F.count(F.lit(1)).cast("double")
    elif how == "sum":
        measure = F.coalesce(F.sum(value), F.lit(0)).cast("double")
    elif how == "mean":
        measure = F.avg(value)
    else:
        measure = F.count(value).cast("double")
    kept = df.na.drop(subset=keys) if keys else df
    slotted = _hour_of(kept, [*keys, *([value] if value else [])], ts)
    return slotted.groupBy(*keys, "ts").agg(measure.alias(name))


def _hour_of(df: DataFrame, keep: list[str], ts: str) -> DataFrame:
    """``keep`` and the hour as ``ts``; the tumbling window compiles to integer arithmetic."""
    return df.select(*keep, F.window(ts, "1 hour").start.alias("ts"))


def wide_hourly(df: DataFrame, keys: list[str], ts: str = "ts", task: str = "task") -> DataFrame:
    """One row per key and hour with a count column per task and the outbound total.

    The tasks are a fixed list, so this is one conditional aggregation and one
    shuffle, without a pivot that must first look up its values.
    """
    counts = [
        F.count(F.when(F.col(task) == t, 1)).cast("double").alias(c)
        for c, t in VOLUME_COLUMNS.items()
    ]
    hourly = _hour_of(df, [*keys, task], ts).groupBy(*keys, "ts").agg(*counts)
    return with_total(hourly, [c for c in VOLUME_COLUMNS if c.startswith("outbound_")])


def with_total(df: DataFrame, columns: list[str], name: str = TOTAL_COLUMN) -> DataFrame:
    """Row-wise sum; a missing part counts as 0."""
    return df.withColumn(name, reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]))


def pivot_types(
    df: DataFrame, keys: list[str], types: list[str], type_col: str = "type", value: str = "count"
) -> DataFrame:
    """Hour by type sums as ``outbound_<type>`` columns with 0 for absent types."""
    sums = [
        F.coalesce(F.sum(F.when(F.col(type_col) == t, F.col(value))), F.lit(0.0))
        .cast("double")
        .alias(f"outbound_{t.lower()}")
        for t in types
    ]
    wide = df.groupBy(*keys, "ts").agg(*sums)
    return with_total(wide, [f"outbound_{t.lower()}" for t in types])


def long_to_wide(df: DataFrame, keys: list[str], value: str = "volume") -> DataFrame:
    """Canonical long table to one column per task; absent tasks are NULL."""
    return df.groupBy(*keys, "ts").agg(
        *[F.sum(F.when(F.col("task") == t, F.col(value))).alias(c) for c, t in VOLUME_COLUMNS.items()]
    )


def wide_to_long(
    df: DataFrame, keys: list[str], value: str = "volume", keep_zero: bool = False
) -> DataFrame:
    """Volumes per task; the total column is left out, unmapped columns too.

    Only positive volumes are kept unless ``keep_zero`` asks for all rows.
    """
    present = [c for c in VOLUME_COLUMNS if c in df.columns]
    pairs = ", ".join(f"'{VOLUME_COLUMNS[c]}', cast(`{c}` as double)" for c in present)
    long = df.select(*keys, "ts", F.expr(f"stack({len(present)}, {pairs}) as (task, {value})"))
    return long if keep_zero else long.filter(F.col(value) > 0)


def merge_wide(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of wide hourly frames on keys and hour."""
    return reduce(lambda left, right: left.join(right, [*keys, "ts"], "full_outer"), frames)


def time_bounds(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row ``(lo, hi)`` of first and last hour: a one-column scan, no shuffle of rows."""
    first, last = F.min(ts), F.max(ts)
    return df.agg(
        (F.to_date(first).cast("timestamp_ntz") + hours(F.hour(first))).alias("lo"),
        (F.to_date(last).cast("timestamp_ntz") + hours(F.hour(last))).alias("hi"),
    )


def hour_bounds(hourly: DataFrame, *values: str) -> DataFrame:
    """``time_bounds`` of an hourly table that is aggregated from the records.

    The values take part, so that both readers of the table need the same columns
    and Spark runs its aggregation, and the scan below, once for both.
    """
    both = F.struct("ts", *values)
    return hourly.agg(F.min(both).alias("lo"), F.max(both).alias("hi")).select(
        F.col("lo.ts").alias("lo"), F.col("hi.ts").alias("hi")
    )


def densify(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    bounds: DataFrame | None = None,
    fill: float | None = 0.0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every hour between the first and the last, absent ones filled.

    Without ``bounds`` each series spans its own hours; with a one-row
    ``(lo, hi)`` frame all series span the same ones, and the further columns of
    that row named in ``carry`` appear in the result. Each row is stretched up
    to the hour before its successor, which takes one window over the series
    and no join against a generated spine.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    one = hours(1)
    ahead = df.withColumn("_next", F.lead("ts").over(w))
    if bounds is None:
        start, stop = F.col("ts"), F.coalesce(F.col("_next") - one, F.col("ts"))
    else:
        ahead = (
            ahead.withColumn("_first", F.lag("ts").over(w).isNull())
            .crossJoin(F.broadcast(bounds.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *carry)))
        )
        start = F.when(F.col("_first"), F.least("ts", "_lo")).otherwise(F.col("ts"))
        stop = F.coalesce(F.col("_next") - one, F.greatest("ts", "_hi"))
    stretched = ahead.withColumn("_h", F.explode(F.sequence(start, stop, F.expr("INTERVAL 1 HOUR"))))
    own = F.col("_h") == F.col("ts")
    if fill is None:
        filled = [F.when(own, F.col(v)).alias(v) for v in values]
    else:
        filled = [F.when(own, F.coalesce(F.col(v), F.lit(fill))).otherwise(F.lit(fill)).alias(v) for v in values]
    return stretched.select(*keys, F.col("_h").alias("ts"), *filled, *carry)


def dense_hourly(
    records: DataFrame, keys: list[str], value: str | None = None, how: str = "sum", ts: str = "ts",
    common_span: bool = True,
) -> DataFrame:
    """Raw records to dense zero-filled series in one go."""
    hourly = aggregate_hourly(records, keys, ts, value, how)
    bounds = hour_bounds(hourly, "volume") if common_span else None
    return densify(hourly, keys, ["volume"], bounds)


def combine(records: DataFrame, keys: list[str], ts: str = "ts", task: str = "task") -> DataFrame:
    """Dense wide hourly table of all tasks with the outbound total."""
    wide = wide_hourly(records, keys, ts, task)
    values = [*VOLUME_COLUMNS, TOTAL_COLUMN]
    return densify(wide, keys, values, hour_bounds(wide, *values))


def missing_hours(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hours without a row between the first and the last of each series."""
    w = Window.partitionBy(*keys).orderBy("ts")
    return (
        df.select(*keys, "ts", F.lead("ts").over(w).alias("_next"))
        .filter(hour_index("_next") - hour_index("ts") > 1)
        .select(
            *keys,
            F.explode(
                F.sequence(F.col("ts") + hours(1), F.col("_next") - hours(1), F.expr("INTERVAL 1 HOUR"))
            ).alias("ts"),
        )
    )
