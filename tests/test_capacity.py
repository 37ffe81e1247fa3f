"""Queueing formulas and plans on hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from shiftcast.config import CAPACITY
from shiftcast.functions import erlang
from shiftcast.operators import capacity, scenarios


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).head()


def lit(x):
    return F.lit(float(x))


def exact_wait(n, a):
    """Erlang C with integers and fractions of factorials."""
    top = a**n / math.factorial(n) * n / (n - a)
    return top / (sum(a**k / math.factorial(k) for k in range(n)) + top)


@pytest.mark.parametrize("a, n", [(100 * 5 / 60, 12), (1, 3), (100, 108), (300, 312)])
def test_required_agents(spark, a, n):
    assert one(spark, n=erlang.required_agents(lit(a), lit(300)))["n"] == n


def test_waiting_probability(spark):
    row = one(spark, c=erlang.wait_probability(F.lit(11), lit(100 * 5 / 60)))
    assert row["c"] == pytest.approx(0.2996, abs=5e-5)
    assert row["c"] == pytest.approx(exact_wait(11, 100 * 5 / 60), abs=1e-12)


def test_waiting_probability_edges(spark):
    row = one(
        spark,
        none=erlang.wait_probability(F.lit(0), lit(2)), idle=erlang.wait_probability(F.lit(3), lit(0)),
        full=erlang.wait_probability(F.lit(5), lit(5)), big=erlang.wait_probability(F.lit(420), lit(400)),
    )
    assert (row["none"], row["idle"], row["full"]) == (0.0, 0.0, 1.0)
    assert 0 < row["big"] < 1


def test_equal_load_and_agents(spark):
    c = erlang.wait_probability(F.lit(5), lit(5))
    row = one(
        spark, sl=erlang.service_level(c, F.lit(5), lit(5), lit(300), lit(20)),
        wait=erlang.wait_seconds(c, F.lit(5), lit(5), lit(300)),
    )
    assert row["sl"] == 0.0 and row["wait"] is None


def test_agents_are_the_fewest(spark):
    loads = [0.05, 0.9, 1.0, 3.7, 8.0, 17.3, 59.9, 143.2, 250.5]
    df = spark.createDataFrame([(x,) for x in loads], "a double")
    n = erlang.required_agents(F.col("a"), lit(300))
    level = lambda k: erlang.service_level(erlang.wait_probability(k, F.col("a")), k, F.col("a"), lit(300), lit(20))
    rows = df.withColumn("n", n).withColumns({"at": level(F.col("n")), "below": level(F.col("n") - 1)}).collect()
    for r in rows:
        assert r["at"] >= 0.8 > r["below"], r


def test_overload_takes_all_agents(spark):
    rows = [("calls", 6000.0 * 60 / 5 / 60 * 12, 5.0, 1.0), ("calls", 0.0, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "task string, volume double, aht_min double, concurrency double")
    full, idle = capacity.staff(df).orderBy(F.desc("volume")).collect()
    assert full["raw_agents"] == 500 and full["service_level"] == 0.0 and full["asa"] is None
    assert (idle["agents"], idle["service_level"], idle["asa"], idle["occupancy"]) == (0, 1.0, 0.0, 0.0)
    assert idle["goal_met"] and not full["goal_met"]


def test_shrinkage_uses_doubles(spark):
    # 21 / 0.7 is a little more than 30 in binary arithmetic.
    assert math.ceil(21 / (1 - 0.30)) == 31
    row = one(spark, n=F.ceil(F.lit(21) / (F.lit(1.0) - F.lit(0.30))))
    assert row["n"] == 31


def test_dedupe_changes_nothing(spark, series):
    df = series([3, 0, 3, 12, 12.5, 40] * 4)
    a = capacity.task_plan(df).orderBy("ts").collect()
    b = capacity.task_plan(df, dedupe=True).select(*capacity.task_plan(df).columns).orderBy("ts").collect()
    assert a == b


def test_opening_hours(spark, series):
    plan = capacity.hourly_plan(series([10] * 24), [])
    assert sorted(r["hour"] for r in plan.collect()) == list(range(8, 20))


def test_hours_without_volume_stay_in_the_plan(spark, series):
    row = capacity.hourly_plan(series([0] * 24), []).filter("hour = 9").head()
    assert (row["total_volume"], row["total_agents"], row["calls_agents"]) == (0.0, 0, None)


def test_rollups(spark, series):
    plan = capacity.hourly_plan(series([100] * 24 + [50] * 24), [])
    hourly = {(r["date"], r["hour"]): r["total_agents"] for r in plan.collect()}
    day = capacity.daily_plan(plan, []).orderBy("date").collect()
    assert [d["peak_agents"] for d in day] == [max(v for (x, _), v in hourly.items() if x == d["date"]) for d in day]
    shifts = capacity.shift_plan(plan, []).orderBy("date", "shift").collect()
    assert [s["shift"] for s in shifts] == ["08:00-16:00", "16:00-20:00"] * 2
    assert shifts[0]["recommended_headcount"] == math.ceil((shifts[0]["peak_agents"] + shifts[0]["avg_agents"]) / 2)


def test_weeks_of_two_years(spark):
    rows = [("2024-01-02 09:00:00", 1.0, 4), ("2025-01-01 09:00:00", 2.0, 6)]
    plan = spark.createDataFrame(rows, "ts string, total_volume double, total_agents bigint").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    assert capacity.weekly_plan(plan, []).count() == 2
    merged = capacity.weekly_plan(plan, [], merge_years=True).collect()
    assert [(r["week"], r["peak_agents"]) for r in merged] == [(1, 6)]


def test_concurrency_halves_the_load(spark, series):
    plan = capacity.task_plan(series([60] * 24, task="emails"))
    assert plan.head()["intensity"] == pytest.approx(60 * 8 / 60 / 2)


def test_identity_scenario_equals_base(spark, series):
    df = series([7, 30, 55] * 8)
    same = scenarios.Scenario("Same")
    for mode in ("replan", "scale"):
        base, other = (
            scenarios.results(df, [s], mode=mode).drop("scenario").head() for s in (scenarios.BASE, same)
        )
        assert base == other
        plain = capacity.summary(capacity.hourly_totals(capacity.task_plan(df), [])).head()
        assert base["total_fte"] == pytest.approx(plain["total_fte_hours"])


def test_scenario_directions(spark, series):
    df = series([20, 35, 60] * 8)
    rows = {r["scenario"]: r for r in scenarios.compare(scenarios.results(df, [scenarios.BASE, *scenarios.PREDEFINED])).collect()}
    assert rows["Base"]["fte_vs_base_pct"] == 0
    assert rows["Peak Season (+30%)"]["fte_vs_base_pct"] > 0 > rows["Efficiency Improvement"]["fte_vs_base_pct"]
    assert rows["Email Shift"]["total_fte"] < rows["Base"]["total_fte"]  # only calls here, a fifth fewer


def test_service_level_costs_more(spark, series):
    swept = scenarios.sensitivity(series([20, 35, 60] * 8), "service_level", [0.5, 0.8, 0.95]).orderBy("value").collect()
    assert swept[0]["cost"] < swept[1]["cost"] < swept[2]["cost"]


def test_unknown_names_are_refused(spark, series):
    with pytest.raises(ValueError):
        scenarios.plan(series([1]), [scenarios.BASE], mode="guess")
    with pytest.raises(ValueError):
        scenarios.sweep("mood", [1.0])


def test_request_overrides(spark, series):
    df = series([80] * 24)
    easy = capacity.summary(capacity.hourly_plan(df, [], CAPACITY.override(service_level=0.5))).head()
    hard = capacity.summary(capacity.hourly_plan(df, [], CAPACITY.override(service_level=0.95, wait_seconds=5.0))).head()
    assert easy["total_fte_hours"] < hard["total_fte_hours"]


def test_search_beyond_the_usual_range(spark):
    # A wait target of zero and a level near 1 need far more agents than the load.
    for a, goal in ((20.0, 0.999999), (3.0, 1.0), (0.01, 0.99), (498.5, 0.8)):
        n = one(spark, n=erlang.required_agents(lit(a), lit(300), goal, 0.0))["n"]

        def level(k):
            return 1 - exact_wait_by_recursion(k, a)

        def exact_wait_by_recursion(k, load):
            b = 1.0
            for j in range(1, k + 1):
                b = load * b / (j + load * b)
            return k * b / (k - load * (1 - b))

        expected = next((k for k in range(math.ceil(a), 501) if k > a and level(k) >= goal), 500)
        assert n == expected, (a, goal)
