"""Pattern forecasts and residual-based intervals.

The pattern forecasters never build a future spine to join against: each past
row (or profile row) is repeated forward to the hours it predicts.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import non_negative, z_score

WEEK = 168


def _origins(df: DataFrame, keys: list[str]) -> DataFrame:
    """First hour after the last known one, per series."""
    return df.groupBy(*keys).agg((F.max("ts") + clock.hours(1)).alias("origin"))


def _with_origin(df: DataFrame, keys: list[str], origin: DataFrame | None) -> DataFrame:
    if origin is None:
        return df.join(_origins(df, keys), keys) if keys else df.crossJoin(_origins(df, keys))
    if "origin" in df.columns:
        return df
    return df.join(origin.select(*keys, "origin").distinct(), keys)


def repeat_last_week(
    history: DataFrame, keys: list[str], horizon: int, origin: DataFrame | None = None
) -> DataFrame:
    """Seasonal-naive forecast: the last known week, repeated over the horizon.

    Returns ``(keys, ts, h, yhat)``. Only the last 168 rows of a series are read.
    """
    weeks = ceil(horizon / WEEK)
    based = _with_origin(history, keys, origin)
    back = clock.hour_index("origin") - clock.hour_index("ts")
    return (
        based.withColumn("_back", back)
        .filter((F.col("_back") >= 1) & (F.col("_back") <= WEEK))
        .withColumn("_week", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
        .withColumn("h", (F.col("_week") * WEEK - F.col("_back") + 1).cast("int"))
        .filter((F.col("h") >= 1) & (F.col("h") <= horizon))
        .select(
            *keys,
            (F.col("ts") + clock.hours(F.col("_week") * WEEK)).alias("ts"),
            "h",
            F.col("volume").alias("yhat"),
        )
    )


def backtest_last_week(df: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """``(keys, ts, yhat, y)`` of the seasonal-naive forecast beside what happened.

    ``df`` holds dense series with an ``origin`` column. Every row speaks for
    itself: from the origin on it is an actual, in the week before it is the
    prediction of later hours. One explode and one aggregation on the
    partitioning the series already have, where forecasting and joining would
    read the series twice.
    """
    weeks = ceil(horizon / WEEK)
    unknown = F.lit(None).cast("double")

    def entry(ts: Column, yhat: Column, y: Column) -> Column:
        return F.struct(ts.alias("ts"), yhat.alias("yhat"), y.alias("y"))

    back = clock.hour_index("origin") - clock.hour_index("ts")
    volume = F.col("volume")
    ahead = [entry(F.col("ts") + clock.hours(WEEK * k), volume, unknown) for k in range(1, weeks + 1)]
    said = (
        F.when(F.col("_back") <= 0, F.array(entry(F.col("ts"), unknown, volume)))
        .when(F.col("_back") <= WEEK, F.array(*ahead))
    )
    spoken = df.withColumn("_back", back).filter(F.col("_back") <= WEEK).select(*keys, "origin", F.explode(said).alias("_e"))
    return (
        spoken.select(*keys, "origin", "_e.*")
        .filter(F.col("ts") < F.col("origin") + clock.hours(horizon))
        .groupBy(*keys, "ts")
        .agg(F.max("yhat").alias("yhat"), F.max("y").alias("y"))
        .filter("yhat IS NOT NULL AND y IS NOT NULL")
    )


def repeat_yesterday(
    history: DataFrame, keys: list[str], horizon: int, origin: DataFrame | None = None
) -> DataFrame:
    """The last known day, repeated over the horizon."""
    days = ceil(horizon / 24)
    based = _with_origin(history, keys, origin)
    back = clock.hour_index("origin") - clock.hour_index("ts")
    return (
        based.withColumn("_back", back)
        .filter((F.col("_back") >= 1) & (F.col("_back") <= 24))
        .withColumn("_day", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .withColumn("h", (F.col("_day") * 24 - F.col("_back") + 1).cast("int"))
        .filter(F.col("h") <= horizon)
        .select(
            *keys, (F.col("ts") + clock.hours(F.col("_day") * 24)).alias("ts"), "h",
            F.col("volume").alias("yhat"),
        )
    )


def week_profile(
    history: DataFrame, keys: list[str], horizon: int, origin: DataFrame | None = None,
    weeks_back: int | None = None,
) -> DataFrame:
    """Mean of each hour of the week, laid over the horizon.

    ``weeks_back`` limits the history to the last weeks (4 gives the four-week
    mean of the same hour). One aggregation to 168 rows per series.
    """
    based = _with_origin(history, keys, origin)
    back = clock.hour_index("origin") - clock.hour_index("ts")
    based = based.withColumn("_back", back).filter("_back >= 1")
    if weeks_back is not None:
        based = based.filter(F.col("_back") <= weeks_back * WEEK)
    # Rows whose distance to the origin agrees modulo one week share a slot.
    slot = F.pmod(-F.col("_back"), F.lit(WEEK))
    weeks = ceil(horizon / WEEK)
    return (
        based.groupBy(*keys, "origin", slot.alias("_slot"))
        .agg(F.avg("volume").alias("yhat"))
        .withColumn("_week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
        .withColumn("h", (F.col("_slot") + F.col("_week") * WEEK + 1).cast("int"))
        .filter(F.col("h") <= horizon)
        .select(*keys, (F.col("origin") + clock.hours(F.col("h") - 1)).alias("ts"), "h", "yhat")
    )


def adjust(df: DataFrame, factors: DataFrame, value: str = "yhat") -> DataFrame:
    """Scales by percent per task; tasks without a factor stay as they are.

    ``factors`` is ``(task, pct)`` with one row per task.
    """
    scaled = F.col(value) * (1 + F.coalesce(F.col("pct"), F.lit(0.0)) / 100)
    return df.join(factors, "task", "left").withColumn(value, scaled).drop("pct")


# Which adjustment a column family takes. Every outbound family
# takes the factor of the first one.
def family_factor(column: Column, call: float, email: float, outbound: float) -> Column:
    name = F.lower(column)
    return (
        F.when(name.contains("call"), F.lit(call))
        .when(name.contains("email"), F.lit(email))
        .when(name.rlike("outbound|ook|omk|nb"), F.lit(outbound))
        .otherwise(F.lit(0.0))
    )


def residual_sigma(residuals: DataFrame, keys: list[str], column: str = "residual") -> DataFrame:
    """Population standard deviation of the holdout residuals per series."""
    return residuals.groupBy(*keys).agg(F.stddev_pop(column).alias("sigma"))


def with_intervals(
    predicted: DataFrame,
    keys: list[str],
    sigma: DataFrame | None = None,
    confidence: float = 0.95,
) -> DataFrame:
    """Adds ``lower`` and ``upper``: z · σ · (1 + ½ √(h / 24)) around ``yhat``, lower ≥ 0.

    σ falls back to the RMSE column of ``sigma`` if it has one, and to a tenth
    of the mean prediction where no spread is known.
    """
    if sigma is not None:
        spread = F.coalesce("sigma", "rmse") if "rmse" in sigma.columns else F.col("sigma")
        sigma = sigma.select(*keys, spread.alias("sigma"))
    else:
        sigma = predicted.groupBy(*keys).agg((F.avg("yhat") * 0.1).alias("sigma"))
    joined = predicted.join(sigma, keys, "left") if keys else predicted.crossJoin(sigma)
    return bounds(joined, confidence)


def bounds(df: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Bounds of rows that carry ``yhat``, ``h`` and ``sigma``; ``sigma`` is consumed."""
    ahead = F.sqrt(F.greatest(F.col("h"), F.lit(0)) / F.lit(24.0))
    width = F.lit(z_score(confidence)) * F.col("sigma") * (1 + ahead * 0.5)
    return (
        df.withColumn("_w", width)
        .withColumn("lower", non_negative(F.col("yhat") - F.col("_w")))
        .withColumn("upper", F.col("yhat") + F.col("_w"))
        .drop("_w", "sigma")
    )


def interval_widths(df: DataFrame, keys: list[str]) -> DataFrame:
    width = F.col("upper") - F.col("lower")
    return df.groupBy(*keys).agg(
        F.avg(width).alias("avg_width"),
        F.max(width).alias("max_width"),
        F.min(width).alias("min_width"),
        F.avg("yhat").alias("avg_prediction"),
        (F.try_divide(F.avg(width), F.avg("yhat")) * 100).alias("relative_pct"),
    )
