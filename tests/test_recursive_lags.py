"""The recursive forecast with the fitted trees: short series, blocks, and what feeds what."""

import math
from dataclasses import replace

import pytest

from shiftcast.config import FORECAST
from shiftcast.operators import learned

SMALL = replace(FORECAST, max_iter=6, patience=3, test_days=3)


@pytest.fixture(scope="module")
def waves(series):
    values = [20 + 8 * math.sin(i / 24 * 2 * math.pi) + (15 if i % 168 == 40 else 0) for i in range(24 * 49)]
    return series(values)


def test_short_series_say_so(spark, series):
    short = series(range(168), task="emails")
    long = series([float(i % 24) for i in range(600)])
    out = learned.forecast_recursive(long.unionByName(short), ["task"], 3, SMALL).collect()
    told = [(r["yhat"], r["lower"], r["upper"], r["reason"]) for r in out if r["task"] == "emails"]
    assert told == [(None, None, None, "too_short")] * 3
    assert [(r["h"], r["reason"]) for r in out if r["task"] == "calls"] == [(1, None), (2, None), (3, None)]
    alone = learned.forecast_recursive(short, ["task"], 2, SMALL).collect()
    assert [(r["h"], r["reason"], str(r["ts"])) for r in sorted(alone, key=lambda r: r["h"])] == [
        (1, "too_short", "2024-01-08 00:00:00"), (2, "too_short", "2024-01-08 01:00:00")]


def test_waves_go_on(waves):
    """Trees that know the same hour of past weeks repeat the day's wave and the weekly peak."""
    config = replace(SMALL, max_iter=60, patience=10, test_days=7)
    out = {r["h"]: r for r in learned.forecast_recursive(waves, ["task"], 48, config).collect()}
    assert sorted(out) == list(range(1, 49)) and max(out, key=lambda h: out[h]["yhat"]) == 41
    assert all(abs(out[h]["yhat"] - 20 - 8 * math.sin((h - 1) / 24 * 2 * math.pi)) < 4 for h in out if h != 41)
    assert all(0 <= r["lower"] <= r["yhat"] <= r["upper"] for r in out.values())


def test_hour_by_hour_equals_a_restart_after_each_hour(waves):
    """With blocks of one hour, each hour is the forecast of the history and all hours before it."""
    span = learned.holiday_span(waves, 3)
    model = learned.fit_for_block(waves, ["task"], 1, span, SMALL, "task")
    out = learned.forecast_recursive(waves, ["task"], 3, SMALL, block=1, model=model, span=span)
    said = {r["h"]: r for r in out.collect()}
    grown = waves
    for h in (1, 2, 3):
        (one,) = learned.forecast_boosted(grown, ["task"], 1, SMALL, model=model, span=span).collect()
        assert one["yhat"] == pytest.approx(said[h]["yhat"], abs=1e-9) and one["ts"] == said[h]["ts"]
        grown = grown.unionByName(out.filter(f"h = {h}").selectExpr("task", "ts", "yhat AS volume"))


def test_features_know_nothing_of_their_block(waves):
    """Changing the last 24 hours changes no feature of the 24 hours after those before."""
    from pyspark.sql import functions as F

    span = learned.holiday_span(waves, 0)
    last = waves.agg(F.max("ts")).first()[0]
    changed = waves.withColumn("volume", F.when(F.col("ts") > F.lit(last) - F.expr("INTERVAL 24 HOURS"), 999.0).otherwise(F.col("volume")))
    one, other = (
        learned.model_features(d, ["task"], 24, span)[0].drop("volume").orderBy(F.desc("ts")).limit(24).collect()
        for d in (waves, changed)
    )
    assert one == other
    columns = learned.model_features(waves, ["task"], 24, span)[1]
    assert {"is_holiday", "volume_lag_168h", "volume_roll_std_48h", "volume_same_hour_mean"} <= set(columns)
    assert not [c for c in columns if c.endswith("_change")] and "volume_lag_1h" not in columns


def test_best_round_and_patience():
    assert learned.best_round([5.0, 4.0, 3.0, 3.5, 3.6, 2.0], patience=2) == 3
    assert learned.best_round([5.0, 4.0, 3.0, 3.5, 3.6, 2.0], patience=3) == 6
    assert learned.best_round([1.0, 1.0, 1.0], patience=5) == 1
