"""Inputs that no query over the driver tables reaches."""

import base64
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.functions import calendar
from shiftcast.functions.clock import ntz
from shiftcast.operators import features, roster, scenarios, seasonal, tracking
from shiftcast.session import new_work_path
from shiftcast.sources import loaders, uploads
from shiftcast.streaming import live, sessions


def test_holidays_before_1970_and_after_2100(spark):
    rows = [("1969-12-25",), ("2154-12-25",), ("1969-12-23",)]
    df = spark.createDataFrame(rows, "day string").select(F.col("day").cast("timestamp_ntz").alias("ts"))
    found = {str(r["ts"].date()): (r["is_holiday"], r["days_to_holiday"]) for r in features.add_holidays(df).collect()}
    assert found == {"1969-12-25": (1, 0), "2154-12-25": (1, 0), "1969-12-23": (0, 2)}


def test_no_rows_have_no_holidays(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz")
    assert features.add_holidays(none).collect() == []
    assert calendar.holidays_in(calendar.years_of(none, "ts")).collect() == []


def test_scenarios_compare_within_their_keys(spark):
    rows = [("a", "Base", 10.0, 100.0), ("a", "x", 20.0, 150.0), ("b", "Base", 40.0, 400.0), ("b", "x", 20.0, 100.0), ("c", "x", 1.0, 1.0)]
    result = spark.createDataFrame(rows, "site string, scenario string, total_fte double, cost double")
    found = {(r["site"], r["scenario"]): r["fte_vs_base_pct"] for r in scenarios.compare(result, keys=["site"]).collect()}
    assert found == {("a", "Base"): 0, ("a", "x"): 100, ("b", "Base"): 0, ("b", "x"): -50, ("c", "x"): None}


def test_nearest_point_per_key(spark):
    rows = [("a", -8.0, 1.0, 2.0), ("a", 7.0, 3.0, 4.0), ("b", -8.0, 5.0, 6.0)]
    swept = spark.createDataFrame(rows, "site string, value double, total_fte double, cost double")
    assert sorted((r["site"], r["value"]) for r in scenarios.nearest_to(swept, 0.0, ["site"]).collect()) == [("a", 7.0), ("b", -8.0)]
    assert [r["value"] for r in scenarios.nearest_to(swept, 0.0).collect()] == [7.0]


def test_stored_tasks_keep_their_own_times(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    rows = [("f", at(0), "1", "calls", at(8), 1.0), ("f", at(0), "1", "calls", at(9), 2.0), ("f", at(0), "1", "emails", at(9), 3.0)]
    schema = "forecast_id string, created_at timestamp_ntz, model_version string, task string, ts timestamp_ntz, yhat double"
    points = spark.createDataFrame(rows, schema)
    back = tracking.points_from_json(tracking.points_to_json(points))
    assert sorted((r["task"], r["ts"], r["yhat"]) for r in back.collect()) == sorted((r[3], r[4], r[5]) for r in rows)


def test_upload_lines_with_quotes_and_other_lengths(spark):
    text = '"Date",Note;s,Calls\r\n2024-01-01,"a, ""b""",5\n2024-01-02,short\n2024-01-03,x,7,more\n'
    payloads = spark.createDataFrame([("f.csv", "calls", base64.b64encode(text.replace("Note;s", "Note").encode()).decode())], "name string, type string, content string")
    values = [r["values"] for r in uploads.rows(uploads.decode(payloads)).collect()]
    assert values == [
        {"date": "2024-01-01", "note": 'a, "b"', "calls": "5"},
        {"date": "2024-01-02", "note": "short", "calls": None},
        {"date": "2024-01-03", "note": "x", "calls": "7"},
    ]


def test_upload_records_follow_the_quotes(spark):
    """Line breaks, both separators, doubled quotes and control characters inside quotes."""
    import base64
    import csv
    import io

    table = [
        ["date", "note", "calls"],
        ["2024-01-01", 'two\nlines; a, b and "c"', "1"],
        ["2024-01-02", "", "2"],
        ["2024-01-03", '""', "3"],
        ["2024-01-04", "\x1d0 \x1e \x1f4 end\r\n", "4"],
    ]
    for sep in ";,":
        out = io.StringIO()
        csv.writer(out, delimiter=sep, lineterminator="\r\n").writerows(table)
        out.write("\r\n" + f'2024-01-05{sep} "x{sep}y" {sep}5\r\n')
        content = base64.b64encode(out.getvalue().encode()).decode()
        payloads = spark.createDataFrame([("a.csv", "calls", content)], "name string, type string, content string")
        values = [r["values"] for r in uploads.rows(uploads.decode(payloads)).collect()]
        assert [[v[c] for c in table[0]] for v in values] == [*table[1:], ["2024-01-05", f"x{sep}y", "5"]]


def test_upload_with_an_odd_quote_splits_at_every_line(spark):
    import base64

    content = base64.b64encode(b'date,note\n2024-01-01,5" pipe\n2024-01-02,x\n').decode()
    payloads = spark.createDataFrame([("a.csv", "calls", content)], "name string, type string, content string")
    values = [r["values"]["note"] for r in uploads.rows(uploads.decode(payloads)).collect()]
    assert values == ['5" pipe', "x"]


def test_upload_finds_a_time_column_by_its_values(spark):
    import base64

    texts = ["calls,x,when\n5,a,01.02.2024 10:00\n6,,02.02.2024\n", "calls,when\n5,soon\n", "calls,when\n"]
    rows = [(f"{k}.csv", "calls", base64.b64encode(t.encode()).decode()) for k, t in enumerate(texts)]
    decoded = uploads.decode(spark.createDataFrame(rows, "name string, type string, content string"))
    found = {r["name"]: r["column_mapping"] for r in uploads.summarise(decoded).collect()}
    assert found == {
        "0.csv": {"call_volume": "calls", "timestamp": "when"}, "1.csv": {"call_volume": "calls"}, "2.csv": {"call_volume": "calls"}}


def test_upload_is_taken_apart_once(spark):
    """Not again in the filter below the rows, whose separator would cost that for every line."""
    rows = [("a.csv", "calls", base64.b64encode(b"Date;Calls\n2024-01-01;1\n").decode())]
    read = uploads.rows(uploads.decode(spark.createDataFrame(rows, "name string, type string, content string")))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("unbase64") == 1
    assert [r["values"] for r in read.collect()] == [{"date": "2024-01-01", "calls": "1"}]


def test_stray_files_are_no_records(spark, tmp_path):
    (tmp_path / "calls.csv").write_text("timestamp\n2024-01-01 08:00:00\n")
    (tmp_path / "call_notes.txt").write_text("timestamp\n2024-01-01 08:00:00\n2024-01-01 08:10:00\n")
    assert [r["volume"] for r in loaders.load_calls(spark, str(tmp_path)).collect()] == [1.0]


def test_two_events_on_one_day(spark):
    events = spark.createDataFrame([("2024-01-01", "campaign")], "date string, name string")
    spec = seasonal.spec_with_events(seasonal.spec_with_calendar(spark, seasonal.SeasonalSpec(), 2024, 2024), events)
    day = (datetime(2024, 1, 1) - datetime(1970, 1, 1)).days
    design = seasonal._design(np.array([day * 24.0]), 0.0, 1.0, spec, [[0]])
    blocks = [block for block, _, _ in seasonal.column_names(spec)]
    assert design[0, np.array(blocks) == "events"].sum() == 2
    assert {spec.event_names[k] for k in spec.event_days[day]} == {"New Year"} and spec.own_events == ("campaign",)


def test_events_belong_to_their_series(spark, series):
    """A campaign of one task raises its day there alone; repeated, unnamed and undated events do no harm."""
    quiet = seasonal.SeasonalSpec(multiplicative=False, yearly=0, monthly=0, weekday_daily=0, weekend_daily=0, changepoints=0, seasonal_scale=100.0)
    values = [10.0] * 24 * 20 + [60.0] * 24 + [10.0] * 24 * 9
    both = series(values, task="calls").unionByName(series([10.0] * 24 * 30, task="emails"))
    rows = [("calls", "2024-01-21", "campaign")] * 2 + [("calls", None, "campaign"), ("calls", "2024-01-31", "campaign"), (None, "2024-01-05", "campaign"), ("emails", "2024-01-02", None)]
    events = spark.createDataFrame(rows, "task string, date string, name string")
    spec = seasonal.spec_with_events(quiet, events)
    said = seasonal.forecast(both, ["task"], 48, spec, include_history=True, events=events)
    day = {(r["task"], r["date"]): r["yhat"] for r in said.groupBy("task", F.to_date("ts").cast("string").alias("date")).agg(F.avg("yhat").alias("yhat")).collect()}
    assert day["calls", "2024-01-21"] == pytest.approx(60, abs=0.5) and day["calls", "2024-01-31"] == pytest.approx(60, abs=0.5)
    assert all(v == pytest.approx(10, abs=0.5) for (task, date), v in day.items() if task == "emails" or date not in ("2024-01-21", "2024-01-31"))
    with pytest.raises(ValueError, match="table is missing"):
        seasonal.fit(both, ["task"], spec)
    assert seasonal.spec_with_events(quiet, events.limit(0)).own_events == ()


def test_predictions_go_on_over_the_years(spark, series):
    spec = seasonal.SeasonalSpec(multiplicative=False, yearly=0, monthly=0, changepoints=0)
    fitted = seasonal.fit(series([float(i % 24) for i in range(24 * 20)], start="2023-12-15 00:00:00"), ["task"], spec)
    out = seasonal.predict(fitted, ["task"], spec, 24 * 400, include_history=True)
    assert out.count() == out.select("ts").distinct().count() == 24 * 420
    assert seasonal.predict(fitted, ["task"], spec, 0).count() == 0

def test_streamed_sessions_end_after_a_longer_gap_only(spark):
    start = datetime(2024, 1, 1)
    minutes = [0, 60, 121]  # exactly an hour, then a minute more
    rows = [(1, start + timedelta(minutes=m)) for m in minutes]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz")
    folder = new_work_path(spark, "gaps")
    df.write.parquet(folder)
    closing = live.Closing(live.read_records(spark, folder, df.schema), "gaps")
    streamed = sessions.live_sessions(closing.stream)
    path = live.write_available(streamed, "gaps-out", close=lambda: closing.close(start + timedelta(days=3)))
    found = sorted((r["start"], r["end"], r["events"]) for r in spark.read.parquet(path).collect())
    batch = sorted((r["start"], r["end"], r["events"]) for r in sessions.sessions(df).collect())
    assert found == batch == [(start, start + timedelta(minutes=60), 2), (rows[2][1], rows[2][1], 1)]


def test_last_hour_of_a_stream_is_given_out(spark):
    df = spark.range(3).select((ntz("2024-01-01 00:10:00") + F.expr("make_dt_interval(0, int(id) * 5)")).alias("ts"), F.lit("a").alias("site"))
    folder = new_work_path(spark, "hours")
    df.write.parquet(folder)
    closing = live.Closing(live.read_records(spark, folder, df.schema), "hours")
    path = live.write_available(live.live_hourly(closing.stream, ["site"]), "hours-out", close=lambda: closing.close(datetime(2024, 1, 5)))
    assert [(str(r["ts"]), r["volume"]) for r in spark.read.parquet(path).orderBy("ts").collect()] == [
        ("2024-01-01 00:00:00", 1.0), ("2024-01-01 05:00:00", 1.0), ("2024-01-01 10:00:00", 1.0)]


def test_roster_through_its_document(spark):
    rows = [("1", "North", 20.0, "a", "Ann", 0.5, True), ("1", "North", 20.0, "b", "Bo", 1.0, False), ("2", "South", 30.0, "c", "Cy", 0.8, True)]
    flat = spark.createDataFrame(rows, "centre string, centre_name string, cost double, agent string, agent_name string, fte double, active boolean")
    assert sorted(tuple(r) for r in roster.from_json(roster.to_json(flat)).select(*flat.columns).collect()) == rows
