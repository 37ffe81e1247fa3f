"""Accuracy, stores, quality and diagnostics on hand-made cases."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.config import FORECAST
from shiftcast.functions import special
from shiftcast.operators import diagnostics, learned, leads, metrics, models, quality, roster, seasonal, tracking
from shiftcast.plans import accuracy
from shiftcast.plans import models as plans_models


def pairs(spark, rows):
    df = spark.createDataFrame([("calls", i, float(p), float(a)) for i, (p, a) in enumerate(rows)], "task string, i int, yhat double, y double")
    return df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("i"))).drop("i")


def test_mape_policies(spark):
    df = pairs(spark, [(4, 0), (9, 10)])

    def share(policy):
        return df.agg(metrics.mape(F.col("yhat"), F.col("y"), policy).alias("m")).head()["m"]

    assert share("nonzero") == pytest.approx(10) and share("positive") == pytest.approx(10)
    assert share("zero_is_0") == pytest.approx(5)
    with pytest.raises(ValueError):
        share("other")


@pytest.mark.parametrize("policy, perfect, imperfect", [("score", 1, 0), ("zero", 0, 0)])
def test_r2_of_constant_actuals(spark, policy, perfect, imperfect):
    def r2(rows):
        return metrics.accuracy(pairs(spark, rows), ["task"], r2_policy=policy).head()["r2"]

    assert r2([(3, 3), (3, 3)]) == perfect
    assert r2([(3, 3), (4, 3)]) == imperfect


def test_accuracy_against_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 9), rng.randint(0, 9)) for _ in range(60)]
    out = metrics.accuracy(pairs(spark, rows), ["task"]).head()
    p, a = np.array(rows).T
    assert out["bias"] == pytest.approx((p - a).mean())
    assert out["rmse"] == pytest.approx(np.sqrt(((p - a) ** 2).mean()))
    assert out["mape"] == pytest.approx((abs(p - a)[a != 0] / a[a != 0]).mean() * 100)
    assert out["r2"] == pytest.approx(1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_unknown_sides_are_left_out(spark):
    df = pairs(spark, [(1, 1), (5, 4)]).unionByName(pairs(spark, [(float("nan"), 2)]))
    assert metrics.accuracy(df, ["task"]).head()["n"] == 2


def test_target_with_zero_actuals_only_is_skipped(spark):
    assert metrics.target_quality(pairs(spark, [(1, 0), (2, 0)]), ["task"]).count() == 0


def test_no_match_scores_zero(spark):
    row = quality.compare(pairs(spark, []), []).head()
    assert (row["overall_accuracy"], row["overall_mape"], row["verdict"]) == (0, 100, "POOR")


def test_verdict_notes(spark):
    low = quality.compare(pairs(spark, [(1, 10), (2, 10)]), []).head()
    assert low["notes"] == ["calls:UNDER_FORECAST"]
    high = quality.compare(pairs(spark, [(20, 10), (30, 10)]), []).head()
    assert high["notes"] == ["calls:OVER_FORECAST"] and high["overall_accuracy"] == 0


def test_confidence(spark):
    rows = [("m", 10.0, 0.9), ("m", 30.0, -1.0)]
    df = spark.createDataFrame(rows, "model string, mape double, r2 double")
    out = quality.indicator(df, ["model"], data_quality=100, horizon_days=7).head()
    # .5 * mean(80, 40) + .3 * mean(90, 0) + .2 * 100 - 3.5
    assert out["score"] == 60.0 and out["level"] == "medium"
    assert out["codes"] == ["PLAN_BUFFER_10_15_PCT", "PATTERNS_VARIABLE", "ERROR_ABOVE_20_PCT"]
    none = quality.confidence(df.limit(0), []).head()
    assert none["score"] == 50.0


def test_peaks(spark):
    # Both thresholds are 10, so each side has four peaks, two of them shared.
    rows = [(10, 10), (10, 10), (1, 10), (1, 10), (10, 1), (10, 1), *[(1, 1)] * 2]
    out = quality.peak_detection(pairs(spark, rows), ["task"]).head()
    assert (out["peaks_detected"], out["peaks_missed"], out["false_alarms"]) == (2, 2, 2)
    assert (out["detection_rate"], out["false_positive_rate"]) == (50.0, 50.0)


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k int, v double, w double")


def test_upsert_conflict(spark):
    old, new = keyed(spark, [(1, 5.0, None), (2, 6.0, 1.0)]), keyed(spark, [(1, 7.0, 8.0), (3, 9.0, 9.0)])
    kept = {r["k"]: (r["v"], r["w"]) for r in tracking.upsert(old, new, ["k"], ["v", "w"]).collect()}
    assert kept == {1: (5.0, 8.0), 2: (6.0, 1.0), 3: (9.0, 9.0)}
    taken = {r["k"]: r["v"] for r in tracking.upsert(old, new, ["k"], ["v"], "new").collect()}
    assert taken[1] == 7.0
    with pytest.raises(ValueError):
        tracking.upsert(old, new, ["k"], ["v"], "both")
    with pytest.raises(ValueError):
        tracking.merge(old, new, ["k"], ["v"], "guess")


def points(spark):
    wide = pairs(spark, [(1, 2), (3, 4), (5, 6)]).select("ts", F.col("yhat").alias("calls"), F.col("y").alias("emails"))
    a = tracking.to_points(wide, "a", "2024-01-01 00:00:00", "1.0.0")
    b = tracking.to_points(wide, "b", "2024-01-02 00:00:00", "1.0.1")
    return a.unionByName(b)


def test_store_round_trips(spark, tmp_path):
    p = points(spark)
    assert p.count() == 12
    tracking.save_points(p, str(tmp_path / "store"))
    again = tracking.load_points(spark, str(tmp_path / "store"), "a")
    assert again.count() == 6
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(forecast_id" in plan
    nested = tracking.points_from_json(tracking.points_to_json(p))
    assert sorted(map(tuple, nested.collect())) == sorted(map(tuple, p.select(*nested.columns).collect()))
    assert [r["forecast_id"] for r in tracking.list_forecasts(p).collect()] == ["b", "a"]
    assert tracking.list_forecasts(p, end=F.lit("2023-01-01").cast("timestamp_ntz")).count() == 0


def test_insights(spark):
    def insights(recent, older):
        rows = [("calls", f"2024-01-{20 - i:02d} 00:00:00", f"f{i}", recent if i < 5 else older) for i in range(10)]
        df = spark.createDataFrame(rows, "task string, created_at string, forecast_id string, mape double")
        assert {r["task"] for r in tracking.high_error_targets(df, ["task"]).collect()} == ({"calls"} if older > 20 else set())
        return tracking.learning_insights(df, ["task"]).head()

    assert insights(10.0, 12.0)["trend"] == "improving"
    assert insights(14.0, 12.0)["trend"] == "declining"
    assert insights(12.5, 12.0)["trend"] is None
    assert insights(30.0, 30.0)["high_error_targets"] == 1


def test_insights_name_the_high_error_targets(spark, tmp_path):
    """Steady calls are forecast well; e-mails and errors that differ from week to week are not."""
    hours = spark.range(21 * 24).withColumn("week", F.floor(F.col("id") / 168))
    loud = F.when(F.col("week") % 2 == 0, 9).otherwise(1)
    rows = hours.select("id", F.explode(F.create_map(F.lit("click"), F.lit(2), F.lit("view"), loud, F.lit("error"), loud)).alias("event_type", "n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))
    events = rows.select(F.lit(1).cast("long").alias("user_id"), ts.alias("ts"), "event_type", F.lit(1.0).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert accuracy.learning_insights(spark, str(tmp_path)).head()["high_error_targets"] == "emails,outbound_nb"


def test_learned_forecasts_read_the_events_once(spark, tmp_path, monkeypatch):
    """What is fitted and extended is a written workload, not a scan of the events for each of its uses."""
    events = spark.createDataFrame([(k, f"2024-01-01 0{k}:10:00", "click", 1.0) for k in range(5)], "user_id long, ts string, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    given = []

    def keep(history, *_, **__):
        given.append(history)
        raise InterruptedError

    for name in ("holiday_span", "forecast_recursive", "forecast_boosted"):
        monkeypatch.setattr(learned, name, keep)
    for query in ("recursive_forecast", "recursive_forecast_checks", "boosted_forecast", "boosted_accuracy"):
        with pytest.raises(InterruptedError):
            getattr(plans_models, query)(spark, str(tmp_path))
    assert len(given) == 4 and all(h.count() == 5 for h in given)
    assert not any("events.parquet" in f for h in given for f in h.inputFiles())


def test_outlook_edges(spark):
    df = spark.createDataFrame([(5.0, 0.0, 0.0)], "forecast double, actual double, adjustment double")
    row = tracking.outlook_accuracy(df).head()
    assert (row["forecast_accuracy"], row["mape"], row["over_forecast"]) == (0, 0, 1)
    assert tracking.error_bands(df).head()["error_pct"] == 500


def test_f_distribution(spark):
    # Squared Student t: P(F(1, 10) > 4.9646) = 5 %, and known table values.
    known = [
        (4.964603, 1.0, 10.0, 0.05, 1e-6), (3.841459, 1.0, 1e7, 0.05, 1e-5), (10.044289, 1.0, 10.0, 0.01, 1e-6),
        (0.0, 1.0, 10.0, 1.0, 0.0), (0.46, 1.0, 5.0, 0.5276, 2e-3), (3.708265, 3.0, 10.0, 0.05, 1e-6), (1.0, 7.0, 7.0, 0.5, 1e-12),
    ]
    df = spark.createDataFrame([*known, (None, 1.0, 5.0, 0.0, 0.0)], "f double, d1 double, d2 double, p double, within double")
    rows = df.withColumn("found", special.f_survival(F.col("f"), F.col("d1"), F.col("d2"))).collect()
    assert all(abs(r["found"] - r["p"]) <= r["within"] for r in rows if r["f"] is not None)
    assert [r["found"] for r in rows if r["f"] is None] == [None]


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 10.0, 123.25, 5e6]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", special.log_gamma(F.col("x")).alias("g"))
    assert all(r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-13) for r in df.collect())


def test_spread_growing_with_prediction(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i + rng.normal() * (0.1 if i < 100 else 5)) for i in range(200)]
    out = diagnostics.heteroscedasticity(diagnostics.residuals(pairs(spark, rows)), ["task"]).head()
    assert out["is_heteroscedastic"] and out["p_value"] < 1e-6
    few = diagnostics.heteroscedasticity(diagnostics.residuals(pairs(spark, rows[:8])), ["task"]).head()
    assert few["statistic"] is None and few["is_heteroscedastic"] is None


def test_qq_pairs_follow_a_normal_sample(spark):
    rng = np.random.default_rng(9)
    out = diagnostics.qq_pairs(diagnostics.residuals(pairs(spark, [(0, x) for x in rng.normal(size=300)])), ["task"]).orderBy("rank").collect()
    assert out[0]["theoretical"] == pytest.approx(-2.326348, abs=1e-6)
    assert out[-1]["share"] == pytest.approx(0.99)
    assert [r["sample"] for r in out] == sorted(r["sample"] for r in out)
    assert np.corrcoef([r["theoretical"] for r in out], [r["sample"] for r in out])[0, 1] > 0.98


def test_normality(spark):
    rng = np.random.default_rng(8)
    skewed = diagnostics.normality(diagnostics.residuals(pairs(spark, [(0, x) for x in rng.exponential(size=300)])), ["task"]).head()
    assert not skewed["is_normal"]


def test_two_growth_rows(spark):
    df = spark.createDataFrame([("2024-01-01", 100), ("2024-02-01", 110)], "date string, leads bigint")
    out = leads.growth(df).head()
    assert out["avg_growth"] == pytest.approx(10) and out["recent_growth"] == pytest.approx(10) and out["trend"] == "rising"
    assert out["total_growth"] == pytest.approx(10)


def test_roster_defaults(spark):
    doc = '{"c1": {"name": "One", "agents": {"a": {"fte": 0.5}, "b": {"is_active": false}}}, "c2": {"name": "Two", "cost_per_agent_hour": 30.0, "agents": {}}}'
    flat = roster.from_json(spark.createDataFrame([(doc,)], "json string"))
    total = roster.totals(flat).head()
    assert (total["centres"], total["agents"], total["active_agents"], total["active_fte"]) == (2, 2, 1, 0.5)
    cost = {r["centre"]: r for r in roster.by_centre(flat).collect()}
    assert cost["c1"]["monthly_cost"] == 0.5 * 25 * 8 * 22
    assert cost["c2"]["hourly_cost"] == 0


def test_model_events(spark):
    from shiftcast.functions.clock import ntz

    data = spark.range(5).withColumn("ts", ntz("2024-01-01 00:00:00"))
    log = models.log_of([
        models.registration(data, "m", "1.0.0", "2024-01-01 00:00:00"),
        models.registration(data, "m", "1.0.1", "2024-01-02 00:00:00"),
    ])
    assert models.current(log).head()["version"] == "1.0.1"
    with pytest.raises(ValueError):
        models.event(log, "m", "1.0.1", "delete", "2024-01-03 00:00:00")
    with pytest.raises(LookupError):
        models.event(log, "m", "9.9.9", "activate", "2024-01-03 00:00:00")
    log = log.unionByName(models.event(log, "m", "1.0.0", "activate", "2024-01-03 00:00:00"))
    assert models.current(log).head()["version"] == "1.0.0"
    log = log.unionByName(models.event(log, "m", "1.0.1", "delete", "2024-01-04 00:00:00"))
    row = models.summary(log).head()
    assert (row["total_versions"], row["active_version"]) == (1, "1.0.0")


def test_fingerprint_sees_every_row(spark):
    a = spark.range(100).withColumn("x", F.col("id") * 2)
    b = a.withColumn("x", F.when(F.col("id") == 77, 0).otherwise(F.col("x")))
    first, again, other = (models.fingerprint(d).head()["data_hash"] for d in (a, a.orderBy(F.desc("id")), b))
    assert first == again != other


def daily(i):
    return 20 + 8 * np.sin(2 * np.pi * i / 24) + 3 * np.sin(2 * np.pi * i / 168)


SPEC = seasonal.SeasonalSpec(multiplicative=False, yearly=0, monthly=0, changepoints=3)


def test_seasonal_regression_learns_the_pattern(spark, series):
    df = series([daily(i) for i in range(24 * 28)])
    out = seasonal.forecast(df, ["task"], 48, SPEC).orderBy("h").collect()
    assert [r["h"] for r in out] == list(range(1, 49))
    for r in out:
        assert r["yhat"] == pytest.approx(daily(24 * 28 - 1 + r["h"]), abs=0.2)
        assert r["lower"] <= r["yhat"] <= r["upper"]
    score = seasonal.cross_validate(df, ["task"], SPEC, days=7).head()
    assert score["n"] == 7 * 24 and score["r2"] > 0.99


def test_seasonal_parts_add_up(spark, series):
    models_ = seasonal.fit(series([daily(i) for i in range(24 * 15)]), ["task"], SPEC)
    out = seasonal.predict(models_, ["task"], SPEC, 24, include_history=True).collect()
    assert len(out) == 24 * 16
    assert all(r["trend"] + r["yearly"] + r["weekly"] + r["other"] == pytest.approx(r["yhat"]) for r in out)


def test_seasonal_start_and_events(spark, series):
    spec = seasonal.spec_with_calendar(spark, SPEC, 2024, 2024)
    assert "New Year" in spec.event_names and "Epiphany" not in spec.event_names
    values = [5.0 if i < 24 else 50.0 for i in range(24 * 14)]  # 1 January is quiet
    models_ = seasonal.fit(series(values), ["task"], spec)
    fitted = seasonal.predict(models_, ["task"], spec, 1, include_history=True).orderBy("ts").collect()
    assert fitted[12]["yhat"] < 15 and fitted[60]["yhat"] > 45
    later = seasonal.predict(models_, ["task"], spec, 48, start="2024-01-16T00:00:00").agg(F.min("ts").alias("t")).head()
    assert str(later["t"]) == "2024-01-16 00:00:00"


def test_recursive_forecast_follows_the_wave(spark, series):
    config = replace(FORECAST, step_size=0.3, max_iter=24, patience=8)
    df = series([daily(i) for i in range(24 * 28)])
    out = learned.forecast_recursive(df, ["task"], 30, config).orderBy("h").collect()
    assert len(out) == 30
    assert max(abs(r["yhat"] - daily(24 * 28 - 1 + r["h"])) for r in out) < 1.0


def test_recursive_forecast_of_a_short_series(spark, series):
    assert learned.forecast_recursive(series([1, 2, 3, 4, 5, 6]), ["task"], 3).count() == 3


def test_boosted_features_know_only_the_past(spark, series):
    df = series(range(100))
    table, columns = learned.model_features(df, ["task"], 30, learned.holiday_span(df, 30))
    lags = [int(c.split("_")[-1][:-1]) for c in columns if "_lag_" in c]
    assert min(lags) >= 30 and "volume" not in columns


def test_registry_document(spark):
    def version(v, day, active):
        return (
            f'{{"model_id": "m", "version": "{v}", "model_type": "fourier", "created_at": "2024-01-0{day}T10:00:00", "created_by": "x", '
            f'"training_data_hash": "ab", "training_samples": 5, "training_date_range": ["2023-01-01T00:00:00", "2023-02-01T00:00:00"], '
            f'"metrics": {{"calls": {{"rmse": {day}.5}}}}, "is_active": {str(active).lower()}}}'
        )

    doc = '{"m": [' + version("1.0.0", 1, True) + "," + version("1.0.1", 2, False) + "]}"
    log = models.from_json(spark.createDataFrame([(doc,)], "json string"))
    row = models.summary(log).head()
    assert (row["total_versions"], row["active_version"]) == (2, "1.0.0")
    assert row["latest_metrics"] == {"calls": {"rmse": 1.5}}
    assert sorted((r["version"], r["value"]) for r in models.metric_rows(log).collect()) == [("1.0.0", 1.5), ("1.0.1", 2.5)]


def test_adjustment_table(spark):
    from shiftcast.operators import forecast

    said = pairs(spark, [(10, 0)]).drop("y")
    factors = spark.createDataFrame([("calls", 20.0)], "task string, pct double")
    assert forecast.adjust(said, factors).head()["yhat"] == pytest.approx(12)
    assert forecast.adjust(said, factors.limit(0)).head()["yhat"] == 10
