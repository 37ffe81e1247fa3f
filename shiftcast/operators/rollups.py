"""Profiles, matrices, summaries and other roll-ups, each as one aggregation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUSINESS_HOURS
from ..functions import clock
from ..functions.clock import DAY_NAMES
from ..functions.numbers import normal_density, ratio
from .features import numeric_columns
from .validate import salted_join


def between(df: DataFrame, start: Column | str, end: Column | str, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; reaches the Parquet scan as a range."""
    def at(x):
        return clock.ntz(x) if isinstance(x, str) else x

    return df.filter(F.col(ts).between(at(start), at(end)))


def daily_totals(df: DataFrame, keys: list[str], columns: list[str], dense: bool = True) -> DataFrame:
    """Sums per day; with ``dense`` the days between that have no rows are 0."""
    sums = df.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns]
    )
    if not dense:
        return sums
    ahead = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    last = F.coalesce(F.date_sub(ahead, 1), F.col("date"))
    stretched = sums.withColumn("_last", last).withColumn("_d", F.explode(F.sequence("date", "_last")))
    return stretched.select(
        *keys,
        F.col("_d").alias("date"),
        *[F.when(F.col("_d") == F.col("date"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in columns],
    )


def hour_profile(df: DataFrame, keys: list[str], columns: list[str], hours=BUSINESS_HOURS) -> DataFrame:
    """Mean per hour of the day inside the business hours."""
    return (
        df.withColumn("hour", F.hour("ts"))
        .filter(F.col("hour").isin(*hours))
        .groupBy(*keys, "hour")
        .agg(*[F.avg(c).alias(c) for c in columns])
    )


def weekday_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean per weekday, Monday first; weekdays without rows appear with NULLs."""
    spark = df.sparkSession
    spine = spark.createDataFrame(list(enumerate(DAY_NAMES)), "day_of_week int, day_name string")
    means = df.groupBy(F.weekday("ts").alias("day_of_week")).agg(*[F.avg(c).alias(c) for c in columns])
    return spine.join(F.broadcast(means), "day_of_week", "left")  # seven rows each


def hour_column(hour: int) -> str:
    return f"h{hour:02d}"


def _matrix(df: DataFrame, keys: list[str], row: Column, value: str, how, hours) -> DataFrame:
    """Hours as columns. An hour nobody ever staffs is 0 throughout; an hour
    that merely lacks a row stays NULL. The window runs over finished matrix
    rows, at most one per calendar day and key."""
    cells = [how(F.when(F.hour("ts") == h, F.col(value))).alias(hour_column(h)) for h in hours]
    matrix = df.filter(F.hour("ts").isin(*hours)).groupBy(*keys, row).agg(*cells)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return matrix.withColumns(
        {
            hour_column(h): F.when(F.count(hour_column(h)).over(whole) == 0, F.lit(0.0)).otherwise(
                F.col(hour_column(h)).cast("double")
            )
            for h in hours
        }
    )


def date_hour_matrix(plan: DataFrame, keys: list[str], value: str = "total_agents", hours=BUSINESS_HOURS) -> DataFrame:
    """Largest value per date and hour."""
    return _matrix(plan, keys, F.to_date("ts").alias("date"), value, F.max, hours)


def weekday_hour_matrix(plan: DataFrame, keys: list[str], value: str = "total_agents", hours=BUSINESS_HOURS) -> DataFrame:
    """Mean value per weekday and hour, to one decimal."""
    return _matrix(plan, keys, F.weekday("ts").alias("day_of_week"), value, lambda c: F.bround(F.avg(c), 1), hours)


def matrix_rows(matrix: DataFrame, hours=BUSINESS_HOURS) -> DataFrame:
    """Mean and peak of each weekday of a weekday by hour matrix."""
    cells = [F.col(hour_column(h)) for h in hours]
    known = reduce(add, [c.isNotNull().cast("int") for c in cells])
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cells])
    return matrix.select(
        "day_of_week",
        ratio(total, known.cast("double")).alias("mean_agents"),
        F.greatest(*cells).alias("peak_agents"),
    )


def matrix_highlights(matrix: DataFrame, hours=BUSINESS_HOURS) -> DataFrame:
    """Peak, mean, busiest weekday and peak hour; ties go to the earliest."""
    pairs = ", ".join(f"{h}, {hour_column(h)}" for h in hours)
    cells = matrix.select("day_of_week", F.expr(f"stack({len(hours)}, {pairs}) as (hour, agents)"))
    # All three views of the cells in one pass: per weekday, per hour, overall.
    views = cells.groupingSets([["day_of_week"], ["hour"], []], "day_of_week", "hour").agg(
        F.grouping_id().alias("_view"), F.avg("agents").alias("m"), F.max("agents").alias("p")
    )

    def winner(column: str, view: int) -> Column:
        rank = F.when(F.col("_view") == view, F.struct(F.col("m"), -F.col(column)))
        return F.max_by(F.col(column), rank)

    overall = F.col("_view") == 3
    return views.agg(
        F.max(F.when(overall, F.col("p"))).alias("peak"),
        F.max(F.when(overall, F.col("m"))).alias("mean"),
        winner("day_of_week", 1).alias("busiest_day"),
        winner("hour", 2).alias("peak_hour"),
    )


def outlook(
    compared: DataFrame,
    grain: str,
    tasks: list[str] | None = None,
    adjustment_pct: float = 0.0,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Forecast, actual, adjustment and final forecast per day, week or month."""
    rows = compared
    if tasks is not None:
        rows = rows.filter(F.col("task").isin(*tasks))
    if start is not None:
        rows = rows.filter(F.to_date("ts") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.filter(F.to_date("ts") <= F.lit(end).cast("date"))
    return (
        rows.groupBy(clock.period_start("ts", grain).alias("period"))
        .agg(F.sum("yhat").alias("forecast"), F.sum("y").alias("actual"))
        .withColumn("adjustment", F.col("forecast") * F.lit(adjustment_pct) / 100)
        .withColumn("final", F.col("forecast") + F.col("adjustment"))
    )


def monthly_comparison(daily: DataFrame, months: int = 6) -> DataFrame:
    """``(date, forecast, actual, adjustment)`` per month, the latest ``months`` only."""
    monthly = daily.groupBy(clock.month_start("date").alias("month")).agg(
        *[F.sum(c).alias(c) for c in ("forecast", "actual", "adjustment")]
    )
    return (
        monthly.orderBy(F.desc("month")).limit(months)
        .withColumn("final", F.col("forecast") + F.col("adjustment"))
    )


def dataset_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row per numeric column: rows, mean, deviation, sum, min, max, span. One pass."""
    cols = numeric_columns(df)
    stats = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "min": F.min, "max": F.max}
    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[fn(c).cast("double").alias(f"{c}__{s}") for c in cols for s, fn in stats.items()],
    )
    entries = ", ".join("'{0}', ".format(c) + ", ".join(f"`{c}__{s}`" for s in stats) for c in cols)
    return one.select(
        "rows", "first_ts", "last_ts",
        F.expr(f"stack({len(cols)}, {entries}) as (column, {', '.join(stats)})"),
    )


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, known and missing cells, distinct values, min, max and mean per column.

    Exact distinct counts send every distinct value through a shuffle;
    ``approximate`` keeps a fixed-size sketch per column instead.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    numeric = set(numeric_columns(df, ()))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        aggs += [F.count(c).alias(f"{c}__known"), distinct(F.col(c)).alias(f"{c}__distinct")]
        for s, fn in (("min", F.min), ("max", F.max), ("mean", F.avg)):
            value = fn(c).cast("double") if c in numeric else F.lit(None).cast("double")
            aggs.append(value.alias(f"{c}__{s}"))
    fields = ["known", "distinct", "min", "max", "mean"]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    entries = ", ".join(
        f"'{c}', '{types[c]}', " + ", ".join(f"`{c}__{s}`" for s in fields) for c in df.columns
    )
    return (
        df.agg(*aggs)
        .select("_rows", F.expr(f"stack({len(df.columns)}, {entries}) as (column, type, {', '.join(fields)})"))
        .select(
            "column", "type", "known",
            (ratio(F.col("known").cast("double"), F.col("_rows").cast("double")) * 100).alias("known_pct"),
            (F.col("_rows") - F.col("known")).alias("missing"),
            "distinct", "min", "max", "mean",
        )
    )


def column_examples(df: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` known values per column as text; each scan stops at its limit."""
    parts = [
        df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("example")).na.drop().limit(n)
        for c in df.columns
    ]
    return reduce(DataFrame.unionByName, parts)


def quality_tiles(df: DataFrame, ts: str | None = None) -> DataFrame:
    """Completeness, missing cells, duplicate rows and span in days.

    Two hashes of 64 bits stand for a row in the search for duplicates, so no row is
    shuffled whole; NULLs are marked, because a hash passes over them."""
    cells_of = [F.col(f"`{c}`") for c in df.columns]
    hashes = [F.xxhash64(F.lit(seed), *[c.isNull() for c in cells_of], *cells_of).alias(f"_h{seed}") for seed in (1, 2)]
    missing = reduce(add, [c.isNull().cast("bigint") for c in cells_of])
    span = F.datediff(F.max(ts), F.min(ts)) if ts else F.lit(None).cast("int")
    cells = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), span.alias("span_days")
    )
    repeated = df.groupBy(*hashes).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows")
    )
    total = F.col("rows") * len(df.columns)
    return cells.crossJoin(repeated).withColumn(
        "completeness_pct", ratio((total - F.col("missing_cells")).cast("double"), total.cast("double")) * 100
    )


def average_per_day(df: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """Sum of each column over the whole days between first and last row."""
    seconds = (clock.epoch_micros(F.max(ts)) - clock.epoch_micros(F.min(ts))) / 1_000_000
    days = F.floor(seconds / 86400).cast("double")
    return df.agg(*[ratio(F.sum(c), days).alias(f"{c}_per_day") for c in columns], days.cast("bigint").alias("days"))


def first_last_change(df: DataFrame, keys: list[str], column: str, order: str = "ts") -> DataFrame:
    """First and last known value in order and their change in percent."""
    known = df.filter(F.col(column).isNotNull())
    return known.groupBy(*keys).agg(
        F.min_by(column, order).alias("first_value"), F.max_by(column, order).alias("last_value")
    ).withColumn("change_pct", ratio(F.col("last_value") - F.col("first_value"), F.col("first_value")) * 100)


def histogram(df: DataFrame, keys: list[str], column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins with the count a normal distribution of the same mean and
    population deviation would give. Bins without rows have 0; if all values of a
    key are equal it has one bin, and none without values."""
    known = df.filter(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_v"))
    stats = known.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg("_v").alias("_mean"),
        F.stddev_pop("_v").alias("_std"), F.count("_v").alias("_n"),
    ).filter("_n > 0")
    bounds = stats.select(*keys, "_lo", "_hi")
    joined = salted_join(known, bounds, keys, "_v") if keys else known.crossJoin(F.broadcast(bounds))  # one row without keys
    width = (F.col("_hi") - F.col("_lo")) / bins
    step = F.coalesce(F.floor(ratio(F.col("_v") - F.col("_lo"), width)), F.lit(0))
    number = F.least(step, F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(width > 0, F.lit(bins - 1)).otherwise(F.lit(0))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    left = F.col("_lo") + F.col("bin") * width
    return every.join(counted, [*keys, "bin"], "left").select(
        *keys, "bin", left.alias("bin_start"), (left + width).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n"),
        (normal_density(left + width / 2, F.col("_mean"), F.col("_std")) * F.col("_n") * width).alias("normal_count"),
    )
