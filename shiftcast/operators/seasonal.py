"""Seasonal Fourier regression per series: trend with changepoints, yearly,
monthly, weekly and daily terms, weekday and weekend day patterns, holidays.

The fit solves the normal equations of a ridge regression. Their sums (X'X and X'y,
a bounded number per series) add up over any split of the rows: tasks sum what they
hold, batch by batch, and Spark sums the tasks, so no task sees a series whole. What
is solved is one small matrix per series. The fitted model is one row per series, and
forecasting expands that row without any join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, clock
from ..functions.numbers import non_negative
from ..session import persist_to_shared
from . import features, metrics
from . import forecast as pattern
from .moments import cross_products, matrix, types_of

HOURS_PER_DAY = 24.0


@dataclass(frozen=True)
class SeasonalSpec:
    multiplicative: bool = True
    yearly: int = 10
    monthly: int = 5
    weekly: int = 3
    daily: int = 4
    weekday_daily: int = 12
    weekend_daily: int = 8
    changepoints: int = 25
    changepoint_range: float = 0.8
    changepoint_scale: float = 0.05
    seasonal_scale: float = 10.0
    # Hours from one value of a series to the next: 24 for daily series.
    step: int = 1
    # A multiplicative model's exponents end here, far above any volume.
    max_exponent: float = 50.0
    # Day number since 1970 -> indexes of its regressors; names in regressor order.
    event_days: dict[int, tuple[int, ...]] = field(default_factory=dict)
    event_names: tuple[str, ...] = ()
    # Names of the caller's events, in regressor order; their days are joined to the rows.
    own_events: tuple[str, ...] = ()


# Period of each seasonal block in days.
PERIODS = {"yearly": 365.25, "monthly": 30.5, "weekly": 7.0, "daily": 1.0, "weekday_daily": 1.0, "weekend_daily": 1.0}


#: Most names of the caller's events; each is a column of the design.
MOST_EVENTS = 200


def spec_with_events(spec: SeasonalSpec, events: DataFrame) -> SeasonalSpec:
    """Adds the names of ``events(date, name)`` as regressors.

    Only the names come to the driver. ``fit`` and ``predict`` take the table itself and join
    its days to the rows; of key columns that it has too, each series gets its own events.
    """
    rows = events.select("name").where("name IS NOT NULL").distinct().limit(MOST_EVENTS + 1).collect()
    if len(rows) > MOST_EVENTS:
        raise ValueError(f"more than {MOST_EVENTS} names of events")
    return replace(spec, own_events=tuple(sorted(r["name"] for r in rows)))


def spec_with_calendar(spark: SparkSession, spec: SeasonalSpec, first_year: int, last_year: int) -> SeasonalSpec:
    """Adds national holidays as regressors: a handful of rows per year, read on the driver."""
    table = calendar.holidays(spark, first_year, last_year, bavaria=False)
    rows = table.select(F.unix_date("date").alias("d"), "name").collect()
    names = tuple(sorted({r["name"] for r in rows}))
    held: dict[int, set[int]] = {}
    for r in rows:
        held.setdefault(r["d"], set()).add(names.index(r["name"]))
    return replace(spec, event_days={d: tuple(sorted(on)) for d, on in held.items()}, event_names=names)


def column_names(spec: SeasonalSpec) -> list[tuple[str, str, float]]:
    """(block, name, ridge weight) of the columns of the design, in order."""
    knot, wave = 1 / spec.changepoint_scale**2, 1 / spec.seasonal_scale**2
    out = [("trend", "one", 0.0), ("trend", "time", 0.0)]
    out += [("trend", f"knot_{k}", knot) for k in range(1, spec.changepoints + 1)]
    for block in PERIODS:
        for k in range(1, getattr(spec, block) + 1):
            out += [(block, f"{block}_{k}_{f}", wave) for f in ("sin", "cos")]
    return out + [("events", f"event_{n}", wave) for n in (*spec.event_names, *spec.own_events)]


#: Added to every ridge weight, so that columns which do not occur leave the matrix regular.
LEAST_WEIGHT = 1e-6


def _design(hours: np.ndarray, start: np.ndarray, span: np.ndarray, spec: SeasonalSpec, own=()) -> np.ndarray:
    """Design matrix of hour numbers; time runs from 0 to 1 over the span of the series.

    ``own`` holds for each hour the indexes of the caller's events on its day, or None."""
    days = hours / HOURS_PER_DAY
    scaled = (hours - start) / np.maximum(span, 1.0)
    dates = np.floor(days).astype(int)
    weekday = (dates + 3) % 7 < 5  # 1970-01-01 was a Thursday
    columns = [np.ones(len(hours)), scaled]
    knots = np.linspace(0, spec.changepoint_range, spec.changepoints + 1)[1:]
    columns += [np.maximum(0.0, scaled - knot) for knot in knots]
    for block, period in PERIODS.items():
        mask = {"weekday_daily": weekday, "weekend_daily": ~weekday}.get(block, np.ones(len(hours)))
        for k in range(1, getattr(spec, block) + 1):
            angle = 2 * np.pi * k * days / period
            columns += [np.sin(angle) * mask, np.cos(angle) * mask]
    if spec.event_names:
        held = np.zeros((len(dates), len(spec.event_names)))
        for at, day in enumerate(dates):
            held[at, list(spec.event_days.get(day, ()))] = 1.0
        columns += list(held.T)
    if spec.own_events:
        held = np.zeros((len(dates), len(spec.own_events)))
        for at, on in enumerate(own):
            if on is not None:
                held[at, np.asarray(on, int)] = 1.0
        columns += list(held.T)
    return np.column_stack(columns)


def _evaluate(hours: np.ndarray, beta: np.ndarray, start, span, spec: SeasonalSpec, own=()) -> pd.DataFrame:
    """Components and total; ``beta`` is one row of coefficients, or one for each hour."""
    terms = _design(hours, start, span, spec, own) * beta
    kind = np.array([block for block, _, _ in column_names(spec)])
    part = {b: terms[:, kind == b].sum(axis=1) for b in ("trend", "yearly", "weekly")}
    total = terms.sum(axis=1)
    part["other"] = total - part["trend"] - part["yearly"] - part["weekly"]
    if spec.multiplicative:
        # Effects multiply: trend is a level, the others are factors minus one.
        out = {k: np.expm1(np.minimum(v, spec.max_exponent)) for k, v in part.items()}
        yhat = np.expm1(np.minimum(total, spec.max_exponent))
    else:
        out, yhat = part, total
    return pd.DataFrame({"h_index": hours, **out, "yhat": yhat})


def _days_of_events(events: DataFrame, keys: list[str], spec: SeasonalSpec) -> tuple[list[str], DataFrame]:
    """(own keys, table): keys that the events have, and one row of event indexes per key and day."""
    by = [k for k in keys if k in events.columns]
    at = F.array_position(F.lit(list(spec.own_events)), F.col("name")).cast("int") - 1
    known = events.where(F.col("name").isin(*spec.own_events))
    day = F.unix_date(F.to_date("date")).alias("_day")
    return by, known.groupBy(*by, day).agg(F.collect_set(at).alias("own"))


def _rows(df: DataFrame, keys: list[str], column: str, spec: SeasonalSpec, events: DataFrame | None) -> DataFrame:
    """(keys, h, y) of the known values, with ``own`` if there are events."""
    rows = df.filter(F.col(column).isNotNull()).select(
        *keys, clock.hour_index("ts").cast("double").alias("h"), F.col(column).cast("double").alias("y")
    )
    if not spec.own_events:
        return rows
    by, days = _days_of_events(_given(events), keys, spec)
    return rows.withColumn("_day", F.floor(F.col("h") / HOURS_PER_DAY).cast("int")).join(days, [*by, "_day"], "left").drop("_day")


def _given(events: DataFrame | None) -> DataFrame:
    if events is None:
        raise ValueError("the model has events of the caller, whose table is missing")
    return events


def _own(pdf: pd.DataFrame):
    return pdf["own"] if "own" in pdf else ()


def _positioned(df: DataFrame, keys: list[str], column: str, spec: SeasonalSpec, events: DataFrame | None) -> DataFrame:
    """(keys, h, y, start, span): each value with the time scale of its series."""
    whole = Window.partitionBy(*keys)
    start = F.min("h").over(whole)
    return _rows(df, keys, column, spec, events).withColumns({"start": start, "span": F.max("h").over(whole) - start})


def normal_equations(
    df: DataFrame, keys: list[str], spec: SeasonalSpec, column: str = "volume", events: DataFrame | None = None
) -> DataFrame:
    """One row per series: start, span, n and ``sums``, the products of the design's columns
    and, in the last row, of the values with them."""

    def vectors(rows: pd.DataFrame) -> np.ndarray:
        hours, y = rows["h"].to_numpy(), rows["y"].to_numpy()
        target = np.log1p(np.maximum(y, 0)) if spec.multiplicative else y
        return np.column_stack([_design(hours, rows["start"].to_numpy(), rows["span"].to_numpy(), spec, _own(rows)), target])

    return cross_products(_positioned(df, keys, column, spec, events), [*keys, "start", "span"], len(column_names(spec)) + 1, vectors)


def fit(
    df: DataFrame, keys: list[str], spec: SeasonalSpec, column: str = "volume", events: DataFrame | None = None
) -> DataFrame:
    """One row per series: coefficients, time scale, last hour and in-sample spread.

    ``events(date, name)`` are those that ``spec_with_events`` took the names of."""
    schema = types_of(df, keys, "beta array<double>", "start double", "span double", "last_hour bigint", "n bigint")
    weights = np.diag([w + LEAST_WEIGHT for _, _, w in column_names(spec)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [matrix(np.asarray(sums)) for sums in pdf["sums"]]
            if whole:
                beta = [np.linalg.solve(m[:-1, :-1] + weights, m[-1, :-1]) for m in whole]
                last = (pdf["start"] + pdf["span"]).astype("int64")
                yield pdf.assign(beta=beta, last_hour=last)[[*keys, "beta", "start", "span", "last_hour", "n"]]

    models = persist_to_shared(normal_equations(df, keys, spec, column, events).mapInPandas(solve, schema), "seasonal-models")
    spread = _spread(_rows(df, keys, column, spec, events), keys, models, spec)
    return models.join(spread, keys) if keys else models.crossJoin(F.broadcast(spread))


def _spread(rows: DataFrame, keys: list[str], models: DataFrame, spec: SeasonalSpec) -> DataFrame:
    """(keys, sigma): deviation of the values from what the models say of them, never below zero."""
    small = models.select(*keys, "beta", "start", "span")
    with_model = rows.join(small, keys) if keys else rows.crossJoin(F.broadcast(small))

    def residual(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                hours, start, span = (pdf[c].to_numpy() for c in ("h", "start", "span"))
                said = _evaluate(hours, np.stack(pdf["beta"]), start, span, spec, _own(pdf))["yhat"].to_numpy()
                yield pdf[keys].assign(residual=pdf["y"].to_numpy() - np.maximum(said, 0))

    return with_model.mapInPandas(residual, types_of(rows, keys, "residual double")).groupBy(*keys).agg(F.stddev_pop("residual").alias("sigma"))


COMPONENTS = ["trend", "yearly", "weekly", "other"]
#: Hours of a series that are evaluated at once.
HOURS_AT_ONCE = 20_000


def predict(
    models: DataFrame, keys: list[str], spec: SeasonalSpec, horizon: int, include_history: bool = False,
    start: str | None = None, events: DataFrame | None = None,
) -> DataFrame:
    """``(keys, ts, h, yhat, sigma, components)``; a year of a series at a time leaves its model row."""
    first = None if start is None else int(np.datetime64(start, "h").astype(int))
    parts = [f"{c} double" for c in (*COMPONENTS, "yhat", "sigma")]
    schema = types_of(models, keys, "h_index bigint", "h int", *parts)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                begin = int(row["start"]) if include_history else row["last_hour"] + spec.step
                hours = np.arange(begin, row["last_hour"] + horizon + 1, spec.step)
                year = hours.astype("datetime64[h]").astype("datetime64[Y]").astype(int) + 1970
                hours = hours[year == row["_year"]]
                if first is not None:
                    hours = hours[hours >= first]
                if not len(hours):
                    continue
                held = row.get("_own")
                own_days = {} if held is None else {e["_day"]: e["own"] for e in held}
                for some in np.array_split(hours, -(-len(hours) // HOURS_AT_ONCE)):
                    own = [own_days.get(day) for day in some // int(HOURS_PER_DAY)] if spec.own_events else ()
                    part = _evaluate(some.astype(float), np.asarray(row["beta"]), row["start"], row["span"], spec, own)
                    part["h_index"] = some
                    part["h"] = (some - row["last_hour"]).astype("int32")
                    part["sigma"] = row["sigma"]
                    for k in keys:
                        part[k] = row[k]
                    yield part[[*keys, "h_index", "h", *COMPONENTS, "yhat", "sigma"]]

    begin = F.col("start").cast("bigint") if include_history else F.col("last_hour") + spec.step
    ends = [F.year(clock.from_hour_index(h)) for h in (begin, F.col("last_hour") + horizon)]
    years = models.withColumn("_year", F.explode(F.when(ends[0] <= ends[1], F.sequence(*ends))))
    if spec.own_events:
        by, days = _days_of_events(_given(events), keys, spec)
        year = F.year(F.date_from_unix_date("_day")).alias("_year")
        # At most the days of a year in one value, whatever the length of the series.
        held = days.groupBy(*by, year).agg(F.collect_list(F.struct("_day", "own")).alias("_own"))
        years = years.join(held, [*by, "_year"], "left")
    out = years.mapInPandas(expand, schema)
    return out.withColumn("ts", clock.from_hour_index("h_index")).drop("h_index")


def forecast(
    df: DataFrame, keys: list[str], horizon: int, spec: SeasonalSpec = SeasonalSpec(), confidence: float = 0.95,
    include_history: bool = False, start: str | None = None, events: DataFrame | None = None,
) -> DataFrame:
    """Prediction with bounds and components, all clamped at zero where they are volumes."""
    out = predict(fit(df, keys, spec, events=events), keys, spec, horizon, include_history, start, events)
    bounded = pattern.bounds(out, confidence)
    return bounded.withColumns({c: non_negative(c) for c in ("yhat", "upper")})


def cross_validate(
    df: DataFrame, keys: list[str], spec: SeasonalSpec = SeasonalSpec(), days: int = 14, min_valid: int = 24,
    events: DataFrame | None = None,
) -> DataFrame:
    """Accuracy on the last days after a fit on the rest; in-sample for short series."""
    split = features.holdout_split(df, keys, days, min_valid)
    models = fit(split.filter("split <> 'valid'"), keys, spec, events=events)
    # A fit without its holdout ends ``days`` early; an in-sample one ends with the series.
    said = predict(models, keys, spec, days * 24, include_history=True, events=events).select(*keys, "ts", non_negative("yhat").alias("yhat"))
    judged = split.filter("split <> 'train'").withColumnRenamed("volume", "y").join(said, [*keys, "ts"])
    return metrics.accuracy(judged, keys, "positive", "zero")


def weekly_effect(components: DataFrame, keys: list[str]) -> DataFrame:
    """Mean weekly component per weekday."""
    return components.groupBy(*keys, F.weekday("ts").alias("day_of_week")).agg(F.avg("weekly").alias("weekly"))
