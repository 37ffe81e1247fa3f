"""Calendar, lag, rolling and trend features, splits and gap filling.

All ordered features of a call share one window specification per series, so
they cost one exchange and one sort. Lags count rows, which equals hours only
on a dense series: pass the result of ``densify``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FORECAST, ForecastConfig
from ..functions import calendar, clock
from ..functions.numbers import finite, ratio

NO_HOLIDAY_DAYS = 30


@dataclass(frozen=True)
class FeatureSet:
    features: DataFrame
    keys: list[str]
    targets: list[str]
    feature_columns: list[str]
    categorical_columns: tuple[str, ...] = (
        "hour", "day_of_week", "day_of_month", "week_of_year", "month", "quarter", "year",
    )

    @property
    def trainable_columns(self) -> list[str]:
        """Features known before the hour they describe: the change columns use
        the target of the very same hour and would give it away."""
        return [c for c in self.feature_columns if not c.endswith("_change")]


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("ts", "timestamp", "date", "hour")) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def add_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    hour, dow, day = F.hour(ts), F.weekday(ts), F.dayofmonth(ts)
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": dow,
            "day_of_month": day,
            "week_of_year": F.weekofyear(ts),
            "month": F.month(ts),
            "quarter": F.quarter(ts),
            "year": F.year(ts),
            "is_weekend": _flag(dow >= 5),
            "is_month_start": _flag(day == 1),
            "is_month_end": _flag(F.last_day(F.to_date(ts)) == F.to_date(ts)),
            "is_work_hours": _flag((hour >= 8) & (hour < 20)),
            "is_peak_hours": _flag(((hour >= 10) & (hour < 12)) | ((hour >= 14) & (hour < 16))),
        }
    )


def add_cyclical(df: DataFrame) -> DataFrame:
    """Sine and cosine of hour, weekday, month and day of month; needs :func:`add_time`."""
    periods = {"hour": ("hour", 24), "dow": ("day_of_week", 7), "month": ("month", 12), "dom": ("day_of_month", 31)}
    out = {}
    for name, (source, period) in periods.items():
        angle = F.lit(2.0) * F.pi() * F.col(source) / F.lit(float(period))
        out[f"{name}_sin"], out[f"{name}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


def holiday_distances(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Distance of each day of ``days(lo, hi)`` to its neighbouring holidays.

    One row per calendar day of the span. Only holidays inside the span count;
    where there is none on a side the distance is 30.
    """
    spanned = days.select(F.to_date("lo").alias("_lo"), F.to_date("hi").alias("_hi"))
    inside = holidays.crossJoin(F.broadcast(spanned)).filter("date BETWEEN _lo AND _hi")
    # At most a few holidays per month of the span.
    listed = inside.agg(F.sort_array(F.collect_set("date")).alias("_all"))
    one_per_day = spanned.select(F.explode(F.sequence("_lo", "_hi")).alias("date"))
    table = one_per_day.crossJoin(F.broadcast(listed))
    d, held = F.col("date"), F.col("_all")
    after = F.array_min(F.filter(held, lambda h: h > d))
    before = F.array_max(F.filter(held, lambda h: h < d))
    is_one = F.array_contains(held, d)
    default = F.lit(NO_HOLIDAY_DAYS)
    return table.select(
        d,
        _flag(is_one).alias("is_holiday"),
        F.when(is_one, 0).otherwise(F.coalesce(F.datediff(after, d), default)).alias("days_to_holiday"),
        F.when(is_one, 0).otherwise(F.coalesce(F.datediff(d, before), default)).alias("days_from_holiday"),
    )


def add_holidays(
    df: DataFrame, ts: str = "ts", holidays: DataFrame | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """is_holiday, days to and from the nearest holiday, and day before/after flags.

    The joined side has one row per calendar day, so broadcasting it is safe.
    """
    span = bounds if bounds is not None else df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    if holidays is None:
        holidays = calendar.holidays_in(calendar.years_between(span))
    table = holiday_distances(span, holidays).withColumnRenamed("date", "_date")
    return (
        df.withColumn("_date", F.to_date(ts))
        .join(F.broadcast(table), "_date", "left")
        .drop("_date")
        .withColumn("is_day_before_holiday", _flag(F.col("days_to_holiday") == 1))
        .withColumn("is_day_after_holiday", _flag(F.col("days_from_holiday") == 1))
    )


def add_event_flags(df: DataFrame, events: DataFrame, names: list[str], ts: str = "ts") -> DataFrame:
    """One 0/1 column per named event of ``events(date, name)``.

    The joined side is reduced to one row per calendar day before the broadcast.
    """
    flags = events.groupBy(F.col("date").alias("_date")).agg(
        *[F.max(_flag(F.col("name") == n)).alias(event_column(n)) for n in names]
    )
    joined = df.withColumn("_date", F.to_date(ts)).join(F.broadcast(flags), "_date", "left").drop("_date")
    return joined.na.fill(0, [event_column(n) for n in names])


def event_column(name: str) -> str:
    return "event_" + "_".join(name.lower().replace("-", " ").split())


def _series(keys: list[str], ts: str = "ts") -> Window:
    return Window.partitionBy(*keys).orderBy(ts)


def add_lags(df: DataFrame, keys: list[str], targets: list[str], lags=FORECAST.lag_hours) -> DataFrame:
    w = _series(keys)
    return df.withColumns({f"{t}_lag_{k}h": F.lag(t, k).over(w) for t in targets for k in lags})


def add_rolling(df: DataFrame, keys: list[str], targets: list[str], windows=FORECAST.rolling_windows) -> DataFrame:
    """Mean, standard deviation, minimum and maximum of the rows before the current one."""
    out = {}
    for t in targets:
        for size in windows:
            w = _series(keys).rowsBetween(-size, -1)
            out[f"{t}_roll_mean_{size}h"] = F.avg(t).over(w)
            out[f"{t}_roll_std_{size}h"] = F.stddev_samp(t).over(w)
            out[f"{t}_roll_min_{size}h"] = F.min(t).over(w)
            out[f"{t}_roll_max_{size}h"] = F.max(t).over(w)
    return df.withColumns(out)


def add_same_time(df: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Same hour yesterday, last week, and its mean over those of the last four weeks that exist."""
    w = _series(keys)
    out = {}
    for t in targets:
        weeks = [F.lag(t, 168 * n).over(w) for n in range(1, 5)]
        total = sum((F.coalesce(x, F.lit(0.0)) for x in weeks[1:]), F.coalesce(weeks[0], F.lit(0.0)))
        known = sum((_flag(x.isNotNull()) for x in weeks[1:]), _flag(weeks[0].isNotNull()))
        out[f"{t}_same_hour_yesterday"] = F.lag(t, 24).over(w)
        out[f"{t}_same_hour_last_week"] = weeks[0]
        out[f"{t}_same_hour_4week_avg"] = ratio(total, known.cast("double"))
    return df.withColumns(out)


def add_trend(df: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Differences to 1, 24 and 168 hours before and relative changes; from zero they are NULL."""
    w = _series(keys)
    out = {}
    for t in targets:
        for name, k in (("hourly", 1), ("daily", 24), ("weekly", 168)):
            out[f"{t}_{name}_change"] = F.col(t) - F.lag(t, k).over(w)
        for name, k in (("hourly", 1), ("daily", 24)):
            out[f"{t}_{name}_pct_change"] = finite(ratio(F.col(t), F.lag(t, k).over(w)) - 1)
    return df.withColumns(out)


def build_features(
    df: DataFrame,
    keys: list[str],
    targets: list[str] | None = None,
    config: ForecastConfig = FORECAST,
    holidays: DataFrame | None = None,
    bounds: DataFrame | None = None,
) -> FeatureSet:
    """All features of dense series; targets default to the numeric columns."""
    targets = targets or [c for c in numeric_columns(df) if c not in keys]
    out = add_cyclical(add_time(df))
    out = add_lags(out, keys, targets, config.lag_hours)
    out = add_rolling(out, keys, targets, config.rolling_windows)
    out = add_same_time(out, keys, targets)
    out = add_trend(out, keys, targets)
    out = add_holidays(out, holidays=holidays, bounds=bounds)
    known = {*keys, "ts", *targets}
    return FeatureSet(out, keys, targets, [c for c in out.columns if c not in known])


def fill_gaps(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Last known value, else the next one, else 0."""
    w = _series(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(ahead), F.lit(0.0))
            for c in columns
        }
    )


def interpolate(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Straight line across inner gaps; trailing gaps hold the last value, leading ones stay NULL."""
    w = _series(keys)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.struct(F.col("_n").alias("n"), F.col(column).alias("v")))
    numbered = df.withColumn("_n", F.row_number().over(w))
    framed = numbered.withColumns({"_a": F.last(at, True).over(back), "_b": F.first(at, True).over(ahead)})
    share = ratio((F.col("_n") - F.col("_a.n")).cast("double"), (F.col("_b.n") - F.col("_a.n")).cast("double"))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share
    filled = (
        F.when(F.col(column).isNotNull(), F.col(column))
        .when(F.col("_a.n").isNull(), F.lit(None).cast("double"))
        .otherwise(F.coalesce(line, F.col("_a.v")))
    )
    return framed.withColumn(column, filled).drop("_n", "_a", "_b")


def moving_averages(df: DataFrame, keys: list[str], column: str, windows=(24, 168, 720)) -> DataFrame:
    """Trailing means, NULL until the window is full."""
    out = {}
    for size in windows:
        w = _series(keys).rowsBetween(-(size - 1), 0)
        out[f"ma_{size}h"] = F.when(F.count(column).over(w) == size, F.avg(column).over(w))
    return df.withColumns(out)


def warm_up_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "_lag_" in c or "_roll_" in c or "_same_hour_" in c]


def train_test_split(
    df: DataFrame, keys: list[str], test_days: int = FORECAST.test_days, min_train: int = FORECAST.min_train_hours,
) -> DataFrame:
    """Adds ``split``: the last ``test_days`` of each series are ``test``, the rest ``train``.

    Rows whose warm-up features are not complete are dropped; a series left with
    too few rows keeps all of them and gets its column medians instead.
    """
    warm = warm_up_columns(df)
    complete = F.lit(True)
    for c in warm:
        complete = complete & F.col(c).isNotNull()
    need = min_train + test_days * 24
    # One small row per series: how many rows are complete, and the medians.
    stats = df.groupBy(*keys).agg(
        F.count_if(complete).alias("_complete"), *[F.median(c).alias(f"_m_{c}") for c in warm]
    )
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    lenient = F.col("_complete") < need
    usable = joined.filter(lenient | complete).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in warm}
    )
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts")))
    return (
        usable.withColumn("split", F.when(back <= test_days * 24, "test").otherwise("train"))
        .drop("_complete", *[f"_m_{c}" for c in warm])
    )


def holdout_split(df: DataFrame, keys: list[str], days: int = 14, min_valid: int = 24) -> DataFrame:
    """Adds ``split`` by date: later than ``days`` before the end is ``valid``.

    A series with fewer than ``min_valid`` valid rows is ``in_sample`` throughout.
    """
    w = Window.partitionBy(*keys)
    cut = F.max("ts").over(w) - clock.hours(days * 24)
    marked = df.withColumn("_late", F.col("ts") > cut)
    enough = F.count_if(F.col("_late")).over(w) >= min_valid
    label = F.when(~enough, "in_sample").when(F.col("_late"), "valid").otherwise("train")
    return marked.withColumn("split", label).drop("_late")


def append_future(df: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """History followed by ``horizon`` hours per series whose targets are NULL."""
    last = df.groupBy(*keys).agg(F.max("ts").alias("_last"))
    future = last.select(
        *keys,
        F.explode(
            F.sequence(F.col("_last") + clock.hours(1), F.col("_last") + clock.hours(horizon), F.expr("INTERVAL 1 HOUR"))
        ).alias("ts"),
    )
    return df.unionByName(future, allowMissingColumns=True)


def unseen_hours(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Hours of the day in which a key has no row: a set of at most 24 numbers per key."""
    seen = df.groupBy(*keys).agg(F.collect_set(F.hour(ts)).alias("_seen"))
    return seen.select(*keys, F.explode(F.array_except(F.sequence(F.lit(0), F.lit(23)), "_seen")).alias("hour"))
