"""Hourly tables, calendar, features and decomposition on hand-made series."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.functions import calendar, clock, numbers
from shiftcast.operators import decompose, features, forecast, hourly, quantiles, rollups, validate


def stamps(spark, rows, schema="ts string, value double"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_sum_of_unknown_values_is_zero(spark):
    df = stamps(spark, [("2024-01-01 00:10:00", None), ("2024-01-01 01:10:00", 2.5)])
    rows = hourly.aggregate_hourly(df, [], value="value").orderBy("ts").collect()
    assert [r["volume"] for r in rows] == [0.0, 2.5]


def test_keyless_records_are_dropped(spark):
    df = stamps(spark, [("2024-01-01 00:10:00", None), ("2024-01-01 00:20:00", 1.0)]).withColumn(
        "type", F.when(F.col("value") > 0, "OOK")
    )
    assert [r["volume"] for r in hourly.aggregate_hourly(df, ["type"]).collect()] == [1.0]


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError):
        hourly.aggregate_hourly(stamps(spark, [("2024-01-01 00:00:00", 1.0)]), [], value="value", how="exec")


def test_densify_fills_and_stretches(spark):
    df = stamps(spark, [("2024-01-01 02:00:00", 5.0), ("2024-01-01 05:00:00", 7.0)]).withColumn("k", F.lit(1))
    inner = hourly.densify(df, ["k"], ["value"]).orderBy("ts").collect()
    assert [r["value"] for r in inner] == [5, 0, 0, 7]
    bounds = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS lo, TIMESTAMP_NTZ'2024-01-01 06:00:00' AS hi")
    outer = hourly.densify(df, ["k"], ["value"], bounds).orderBy("ts").collect()
    assert [r["value"] for r in outer] == [0, 0, 5, 0, 0, 7, 0]
    lone = hourly.densify(df.limit(1), ["k"], ["value"], bounds)
    assert lone.count() == 7
    holes = hourly.densify(df, ["k"], ["value"], fill=None).orderBy("ts").collect()
    assert [r["value"] for r in holes] == [5, None, None, 7]
    assert hourly.missing_hours(df, ["k"]).count() == 2


def test_hour_index_round_trip(spark):
    df = stamps(spark, [("2024-02-29 23:00:00", 1.0), ("1969-12-31 23:00:00", 1.0), ("1970-01-01 00:00:00", 1.0)])
    back = df.select("ts", clock.from_hour_index(clock.hour_index("ts")).alias("again"))
    assert all(r["ts"] == r["again"] for r in back.collect())
    micro = stamps(spark, [("2024-02-29 23:59:59.123456", 1.0), ("1969-12-31 23:00:00.5", 1.0)])
    again = micro.select("ts", clock.from_instant(clock.as_instant("ts")).alias("again"))
    assert all(r["ts"] == r["again"] for r in again.collect())


def test_clock_ignores_the_session_zone(spark):
    # 02:30 does not exist in Berlin on this day; a wall-clock time has no zone.
    df = stamps(spark, [("2024-03-31 02:30:00", 1.0)])
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        row = df.select(
            clock.hour_floor("ts").cast("string").alias("h"),
            clock.from_instant(clock.as_instant("ts")).cast("string").alias("i"),
        ).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row["h"] == "2024-03-31 02:00:00" and row["i"] == "2024-03-31 02:30:00"


# Holidays of 2024 in Bavaria.
HOLIDAYS_2024 = {
    "2024-01-01", "2024-01-06", "2024-03-29", "2024-04-01", "2024-05-01", "2024-05-09", "2024-05-20", "2024-05-30",
    "2024-08-15", "2024-10-03", "2024-11-01", "2024-12-25", "2024-12-26",
}


def dates(df):
    return {str(r["date"]) for r in df.collect()}


def test_holidays(spark):
    assert dates(calendar.holidays(spark, 2024, 2024)) == HOLIDAYS_2024
    assert dates(calendar.holidays(spark, 2024, 2024, assumption=False)) == HOLIDAYS_2024 - {"2024-08-15"}
    national = HOLIDAYS_2024 - {"2024-01-06", "2024-05-30", "2024-08-15", "2024-11-01"}
    assert dates(calendar.holidays(spark, 2024, 2024, bavaria=False)) == national
    assert "2017-10-31" in dates(calendar.holidays(spark, 2017, 2017))
    assert "1994-11-16" in dates(calendar.holidays(spark, 1994, 1995))
    assert not {d for d in dates(calendar.holidays(spark, 1989, 1989)) if d.endswith("10-03")}


def test_retail_events(spark):
    def friday(rule):
        return dates(calendar.retail_events(spark, 2024, 2024, rule).filter("name = 'Black Friday'"))

    # November 2024 starts on a Friday, so its fourth one is the 22nd.
    assert friday("fourth_friday") == {"2024-11-22"}
    assert friday("after_thanksgiving") == {"2024-11-29"}
    assert calendar.retail_events(spark, 2024, 2024).count() == 13


def test_time_features(spark):
    df = stamps(spark, [("2024-02-29 15:00:00", 1.0), ("2024-12-30 20:00:00", 1.0), ("2024-06-01 10:00:00", 1.0)])
    a, b, c = features.add_time(df).select("is_month_end", "week_of_year", "is_peak_hours", "is_work_hours", "is_weekend", "is_month_start").collect()
    assert (a["is_month_end"], a["is_peak_hours"], a["is_work_hours"]) == (1, 1, 1)
    assert (b["week_of_year"], b["is_work_hours"]) == (1, 0)
    assert (c["is_weekend"], c["is_month_start"], c["is_peak_hours"]) == (1, 1, 1)


def test_holiday_distances(spark):
    def near(lo, hi):
        span = spark.sql(f"SELECT DATE'{lo}' AS lo, DATE'{hi}' AS hi")
        return {
            str(r["date"]): (r["is_holiday"], r["days_to_holiday"], r["days_from_holiday"])
            for r in features.holiday_distances(span, calendar.holidays(spark, 2023, 2025)).collect()
        }

    assert set(near("2024-02-05", "2024-02-20").values()) == {(0, 30, 30)}
    around = near("2024-04-30", "2024-05-10")
    assert around["2024-04-30"] == (0, 1, 30)
    assert around["2024-05-01"] == (1, 0, 0)
    assert around["2024-05-08"] == (0, 1, 7)
    # Whit Monday lies outside the span and does not count.
    assert around["2024-05-10"] == (0, 30, 1)


def test_one_row_window(spark, series):
    rows = features.add_rolling(series([4, 9]), ["task"], ["volume"], (24,)).orderBy("ts").collect()
    assert [rows[0][f"volume_roll_{s}_24h"] for s in ("mean", "std", "min", "max")] == [None] * 4
    assert rows[1]["volume_roll_mean_24h"] == 4 and rows[1]["volume_roll_std_24h"] is None


def test_change_from_zero_is_unknown(spark, series):
    rows = features.add_trend(series([0, 5, 0, 0]), ["task"], ["volume"]).orderBy("ts").collect()
    assert [r["volume_hourly_pct_change"] for r in rows] == [None, None, -1.0, None]


def test_four_week_mean_uses_what_there_is(spark, series):
    rows = features.add_same_time(series([i for i in range(170)]), ["task"], ["volume"]).orderBy("ts").collect()
    assert rows[167]["volume_same_hour_4week_avg"] is None
    assert rows[169]["volume_same_hour_4week_avg"] == 1.0


def test_gap_fill_and_interpolation(spark, series):
    df = series([None, 2, None, None, 8, None])
    filled = features.fill_gaps(df, ["task"], ["volume"]).orderBy("ts").collect()
    assert [r["volume"] for r in filled] == [2, 2, 2, 2, 8, 8]
    line = features.interpolate(df, ["task"], "volume").orderBy("ts").collect()
    assert [r["volume"] for r in line] == [None, 2, 4, 6, 8, 8]
    empty = features.fill_gaps(series([None, None]), ["task"], ["volume"]).collect()
    assert [r["volume"] for r in empty] == [0, 0]


def test_split_is_ordered_and_disjoint(spark, series):
    df = features.add_lags(series(range(900)), ["task"], ["volume"], (1, 24))
    parts = {r["split"]: r for r in features.train_test_split(df, ["task"]).groupBy("split").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).collect()}
    assert parts["test"]["n"] == 336 and parts["train"]["n"] == 900 - 24 - 336
    assert parts["train"]["b"] < parts["test"]["a"]


def test_short_series_split_keeps_all_rows(spark, series):
    df = features.add_lags(series(range(400)), ["task"], ["volume"], (24,))
    out = features.train_test_split(df, ["task"])
    assert out.count() == 400 and out.filter("volume_lag_24h IS NULL").count() == 0


def test_holdout_of_short_series_is_in_sample(spark, series):
    assert {r["split"] for r in features.holdout_split(series(range(30)), ["task"], days=0).collect()} == {"in_sample"}
    assert features.holdout_split(series(range(400)), ["task"], days=2).filter("split = 'valid'").count() == 48


def test_feature_set_hides_leaking_columns(spark, series):
    made = features.build_features(series(range(30)), ["task"])
    assert made.targets == ["volume"]
    assert "volume_hourly_pct_change" in made.feature_columns
    assert not [c for c in made.trainable_columns if c.endswith("_change")]


def test_repeat_last_week(spark, series):
    out = forecast.repeat_last_week(series(range(400)), ["task"], 200).orderBy("h").collect()
    assert [r["h"] for r in out] == list(range(1, 201))
    assert [r["yhat"] for r in out] == [400 - 168 + (h % 168) for h in range(200)]


def test_week_profile(spark, series):
    values = [i % 168 for i in range(168 * 3 + 5)]
    out = forecast.week_profile(series(values), ["task"], 170).orderBy("h").collect()
    assert [r["yhat"] for r in out] == [(len(values) + h) % 168 for h in range(170)]


def test_backtest_equals_forecast_and_join(spark, series):
    random.seed(1)
    df = series([random.randint(0, 9) for _ in range(700)])
    origin = clock.ntz("2024-01-20 00:00:00")
    both = forecast.backtest_last_week(df.withColumn("origin", origin), ["task"], 216).orderBy("ts").collect()
    past = df.filter(F.col("ts") < origin)
    ahead = forecast.repeat_last_week(past, ["task"], 216)
    expected = ahead.join(df.withColumnRenamed("volume", "y"), ["task", "ts"]).select("task", "ts", "yhat", "y").orderBy("ts").collect()
    assert both == expected and len(both) == 216


def test_intervals_widen_and_contain(spark, series):
    said = forecast.repeat_last_week(series([i % 24 for i in range(200)]), ["task"], 48)
    sigma = spark.createDataFrame([("calls", 2.0)], "task string, sigma double")
    rows = forecast.with_intervals(said, ["task"], sigma).orderBy("h").collect()
    assert all(r["lower"] <= r["yhat"] <= r["upper"] and r["lower"] >= 0 for r in rows)
    width = [r["upper"] - r["yhat"] for r in rows]
    assert width == sorted(width)
    assert width[23] == pytest.approx(1.959964 * 2 * 1.5, abs=1e-5)


def test_family_factors(spark):
    names = spark.createDataFrame([("call_volume",), ("Email_Count",), ("outbound_nb",), ("chat",)], "c string")
    out = names.select("c", forecast.family_factor(F.col("c"), 1, 2, 3).alias("f")).collect()
    assert [r["f"] for r in out] == [1, 2, 3, 0]


def test_linear_trend_and_pattern_are_recovered(spark, series):
    pattern = [3.0, -1.0, -4.0, 2.0]
    parts = decompose.decompose(series([10 + 0.5 * i + pattern[i % 4] for i in range(40)]), ["task"], period=4)
    rows = parts.orderBy("ts").collect()
    for i, r in enumerate(rows):
        assert r["trend"] == pytest.approx(10 + 0.5 * i, abs=1e-9)
        assert r["seasonal"] == pytest.approx(pattern[i % 4], abs=1e-9)
        assert r["residual"] == pytest.approx(0, abs=1e-9)
    total = decompose.summary(parts, ["task"]).head()
    assert total["direction"] == "increasing" and total["seasonal_strength"] == pytest.approx(1)


def test_multiplicative_parts_multiply_back(spark, series):
    random.seed(3)
    df = series([(20 + i) * (1 + 0.3 * math.sin(i)) + random.random() for i in range(70)])
    rows = decompose.decompose(df, ["task"], period=7, model="multiplicative").collect()
    assert all(r["trend"] * r["seasonal"] * r["residual"] == pytest.approx(r["observed"]) for r in rows)


def test_pacf_of_an_autoregression(spark, series):
    rng = np.random.default_rng(5)
    x = [0.0]
    for _ in range(1500):
        x.append(0.7 * x[-1] + rng.normal())
    rows = {r["lag"]: r["pacf"] for r in decompose.pacf(series(x), ["task"], lags=6).collect()}
    assert rows[0] == 1 and rows[1] == pytest.approx(0.7, abs=0.06)
    assert all(abs(rows[k]) < 0.1 for k in range(2, 7))


def test_pacf_equals_yule_walker(spark, series):
    rng = np.random.default_rng(6)
    x = rng.normal(size=200).cumsum()
    rows = {r["lag"]: r["pacf"] for r in decompose.pacf(series(x), ["task"], lags=5).collect()}
    c = x - x.mean()
    r = np.array([(c[: len(c) - k] * c[k:]).sum() / (len(c) - k) for k in range(6)])
    for k in range(1, 6):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert rows[k] == pytest.approx(np.linalg.solve(toeplitz, r[1 : k + 1])[-1], abs=1e-9)


def test_stationarity(spark, series):
    rng = np.random.default_rng(7)
    noise = rng.normal(size=400)
    both = series(noise, task="noise").unionByName(series(noise.cumsum(), task="walk")).unionByName(series([1.0] * 50, task="flat"))
    rows = {r["task"]: r for r in decompose.stationarity(both, ["task"]).collect()}
    assert rows["noise"]["is_stationary"] and not rows["walk"]["is_stationary"]
    assert "flat" not in rows
    for r in rows.values():
        assert r["critical_1"] < r["critical_5"] < r["critical_10"]
        assert r["critical_5"] == pytest.approx(-2.868, abs=0.01)
        assert r["is_stationary"] == (r["statistic"] < r["critical_5"])


def full_regression(x, lags, drop):
    """t statistic of the level and AIC of Δx on level, differences and constant, by least squares."""
    dx = np.diff(x)
    rows = np.arange(drop, len(dx))
    design = np.column_stack([x[rows], *[dx[rows - k] for k in range(1, lags + 1)], np.ones(len(rows))])
    beta = np.linalg.lstsq(design, dx[rows], rcond=None)[0]
    left = ((dx[rows] - design @ beta) ** 2).sum()
    error = np.sqrt(np.linalg.inv(design.T @ design)[0, 0] * left / (len(rows) - design.shape[1]))
    return beta[0] / error, len(rows) * np.log(left / len(rows)) + 2 * design.shape[1]


@pytest.mark.parametrize("n, max_lags", [(400, None), (90, None), (12, None), (60, 3), (60, 0)])
def test_stationarity_equals_one_regression_per_lag(spark, series, n, max_lags):
    rng = np.random.default_rng(n)
    x = 100 + rng.normal(size=n + 1).cumsum() * 0.3 + rng.normal(size=n + 1) + np.sin(np.arange(n + 1))
    other = series(rng.normal(size=700), task="longer")  # makes all vectors wider
    df = series(x[:n]).unionByName(other).withColumn("volume", F.col("volume"))
    (row,) = decompose.stationarity(df, ["task"], max_lags=max_lags).filter("task = 'calls'").collect()
    limit = min(max_lags if max_lags is not None else int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    lags = min(range(limit + 1), key=lambda k: full_regression(x[:n], k, limit)[1])
    assert row["n_lags"] == lags and row["n"] == n
    assert row["statistic"] == pytest.approx(full_regression(x[:n], lags, lags)[0], rel=1e-7)


def test_dickey_fuller_p_value_is_5_percent_at_its_critical_value():
    assert decompose.df_p_value(decompose.critical_value("5%", 10**9)) == pytest.approx(0.05, abs=2e-3)
    assert decompose.df_p_value(decompose.critical_value("1%", 10**9)) == pytest.approx(0.01, abs=1e-3)
    assert decompose.df_p_value(-2.7) < decompose.df_p_value(-1.0)


def test_exact_quantiles(spark):
    rng = random.Random(11)
    # One group holds most of the rows, and a third of them are one value.
    data = [("hot", 5.0 if rng.random() < 0.34 else rng.expovariate(0.1)) for _ in range(4000)]
    data += [("cold", float(i)) for i in range(10)] + [("one", 3.5)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    rows = quantiles.exact_quantiles(df, ["k"], "v", shares).collect()
    for r in rows:
        values = np.array([v for k, v in data if k == r["k"]])
        assert r["n"] == len(values)
        for name, q in shares.items():
            assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-9), (r["k"], name)
    total = quantiles.exact_quantiles(df, [], "v", {"p50": 0.5}).head()
    assert total["p50"] == pytest.approx(np.median([v for _, v in data]))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_exact_quantiles_by_narrowing(spark, monkeypatch, broadcast):
    """Many rounds on few rows: spread over magnitudes, infinities, one value for most rows."""
    monkeypatch.setattr(quantiles, "FEW_ROWS", 3)
    monkeypatch.setattr(quantiles, "PARTS", 8)
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", broadcast)
    rng = random.Random(12)
    data = [("wide", 10 ** rng.uniform(-12, 12)) for _ in range(150)] + [("flat", 2.0)] * 60 + [("flat", -1.0)]
    data += [("ends", v) for v in (float("-inf"), float("inf"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)]
    df = spark.createDataFrame([*data, ("ends", None), ("ends", float("nan")), ("none", None)], "k string, v double")
    rows = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "v", {"p25": 0.25, "p50": 0.5, "p90": 0.9}).collect()}
    assert set(rows) == {"wide", "flat", "ends"}
    for k in rows:
        values = np.array([v for key, v in data if key == k])
        assert rows[k]["n"] == len(values)
        for name, q in {"p25": 0.25, "p50": 0.5, "p90": 0.9}.items():
            if k != "ends" or name != "p90":  # between 7 and infinity
                assert rows[k][name] == pytest.approx(np.quantile(values, q), rel=1e-9)


def test_intervals_of_a_hot_series_spread_over_ranges(spark):
    """70 % of the rows are one series, most of them within one hour."""
    rng = random.Random(13)
    start = datetime(2024, 1, 1)
    rows = [("hot", start + timedelta(milliseconds=rng.randint(0, 3_000_000))) for _ in range(7000)]
    rows += [(f"cold{k % 30}", start + timedelta(minutes=rng.randint(0, 50_000))) for k in range(3000)]
    df = spark.createDataFrame([(k, str(t)) for k, t in rows], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    expected = Counter()
    for key in {k for k, _ in rows}:
        at = sorted(t for k, t in rows if k == key)
        expected.update((key, (b - a) // timedelta(microseconds=1)) for a, b in zip(at, at[1:]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = validate.interval_counts(df, ["k"]).collect()
        seen = df.distinct().repartitionByRange("k", "ts").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["k"], r["micros"]): r["n"] for r in found} == dict(expected)
    assert len(seen) > 2 and max(r["count"] for r in seen) < 0.5 * sum(r["count"] for r in seen)


def test_one_gap(spark):
    hours = [h for h in range(24) if not 10 <= h < 14]
    df = stamps(spark, [(f"2024-01-01 {h:02d}:00:00", 1.0) for h in hours])
    row = validate.intervals(df, []).head()
    assert (row["gaps"], row["median_seconds"], row["largest_seconds"], row["granularity_seconds"]) == (1, 3600, 5 * 3600, 3600)


def test_gap_across_days(spark):
    df = stamps(spark, [("2024-01-01 23:00:00", 1.0), ("2024-01-02 01:00:00", 1.0), ("2024-01-02 02:00:00", 1.0), ("2024-01-02 02:00:00", 1.0)])
    row = validate.intervals(df, []).head()
    assert (row["largest_seconds"], row["duplicates"], row["median_seconds"]) == (7200, 1, 3600)


def test_validation_of_unreadable_and_missing_columns(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("soon", 2)], "ts string, calls int")
    codes = {r["code"]: r["n"] for r in validate.validate(df, "2024-02-01 00:00:00", data_type="calls").collect()}
    assert codes["INVALID_TIMESTAMP_FORMAT"] == 1 and "MISSING_REQUIRED_COLUMNS" not in codes
    bare = spark.createDataFrame([(1,)], "x int")
    assert {r["code"] for r in validate.validate(bare, "2024-01-01 00:00:00").collect()} == {"MISSING_TIMESTAMP", "MISSING_VALUE_COLUMNS"}


def test_empty_data(spark):
    df = stamps(spark, [], "ts string, call_volume double")
    codes = {r["code"] for r in validate.validate(df, "2024-01-01 00:00:00").collect()}
    assert codes == {"DATA_EMPTY"}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "k int, id int")
    assert sorted(r["id"] for r in validate.duplicates(df, ["k"], ["id"]).collect()) == [2, 3]


def test_ranked_rows_are_limited_before_the_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("v"), "id")
    out = validate.offending_rows(df, {"LOW": F.col("v") < 6, "ANY": F.col("v") >= 0}, ["id"], 3)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["code"], r["id"]) for r in out.collect()) == [("ANY", 0), ("ANY", 1), ("ANY", 2), ("LOW", 0), ("LOW", 1), ("LOW", 2)]


def test_normal_quantile(spark):
    from statistics import NormalDist

    shares = [0.0005, 0.01, 0.024, 0.2, 0.5, 0.77, 0.99, 0.9999]
    df = spark.createDataFrame([(p,) for p in shares], "p double")
    for r in df.select("p", numbers.normal_quantile(F.col("p")).alias("q")).collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-7)


def test_display_forms(spark):
    df = spark.createDataFrame([(950.4, 59.0), (1234.0, 60.0), (-2_500_000.0, 90_000.0)], "x double, s double")
    rows = df.select(numbers.compact_number(F.col("x")).alias("x"), numbers.humanize_seconds(F.col("s")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("950", "59 second(s)"), ("1.2K", "1 minute(s)"), ("-2.5M", "1 day(s)")]


def test_histogram_counts_everything(spark, series):
    out = rollups.histogram(series([0, 0, 5, 10, 10]), ["task"], "volume", bins=5).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in out] == [(0, 2), (1, 0), (2, 1), (3, 0), (4, 2)]
    flat = rollups.histogram(series([3, 3]), ["task"], "volume").collect()
    assert [(r["bin"], r["n"]) for r in flat] == [(0, 2)]
    assert rollups.histogram(series([3, 3, 4]), [], "volume", bins=2).count() == 2
    none = series([3.0]).withColumn("volume", F.lit(None).cast("double"))
    assert rollups.histogram(none, ["task"], "volume").count() == rollups.histogram(none, [], "volume").count() == 0


def test_quality_tiles_tell_rows_apart(spark):
    """Values that only change places with NULLs are other rows; rows of equal NULLs are the same."""
    rows = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), (None, None, None), (None, None, None), ("", "a", 0.0)]
    df = spark.createDataFrame(rows, "`x.y` string, b string, c double")
    row = rollups.quality_tiles(df).head()
    assert (row["rows"], row["duplicate_rows"], row["missing_cells"]) == (6, 2, 9)
    empty = rollups.quality_tiles(df.limit(0)).head()
    assert (empty["rows"], empty["duplicate_rows"], empty["completeness_pct"]) == (0, 0, None)


def test_column_examples(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "n int, s string")
    out = rollups.column_examples(df, 2).collect()
    assert {r["column"] for r in out} == {"n", "s"} and len(out) == 4


def test_approximate_profile_agrees_on_small_data(spark):
    df = spark.createDataFrame([(i % 5, str(i)) for i in range(40)], "n int, s string")
    exact = {r["column"]: r for r in rollups.column_profile(df).collect()}
    about = {r["column"]: r for r in rollups.column_profile(df, approximate=True).collect()}
    assert exact["n"]["distinct"] == about["n"]["distinct"] == 5
    assert exact["s"]["min"] is None and exact["n"]["mean"] == 2.0
