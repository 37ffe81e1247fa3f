"""Staffing queries: flagship, plans, roll-ups and the Erlang table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CAPACITY, TASK_DEFAULTS, TASKS
from ..functions import clock
from ..operators import capacity, forecast, hourly
from . import base
from .base import SERIES, Catalog, cte, d, i, r, t

catalog = Catalog()

# Erlang C by sums of exp(k ln a - ln k!), independent of the recursion used in Spark.
PARAMS = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {aht}::DOUBLE, {conc}::DOUBLE)" for k, (aht, conc) in TASK_DEFAULTS.items()
) + ") AS p(task, aht_min, concurrency)"


def solver(loads: str, prefix: str = "") -> dict[str, str]:
    """CTEs that solve distinct ``(intensity, aht, goal, wait)`` rows of ``loads``."""
    return {
        f"{prefix}cand": f"SELECT intensity, aht, goal, wait, unnest(range(greatest(1, ceil(intensity)::BIGINT), "
        f"least(501, ceil(intensity + 8 * sqrt(intensity) + 40)::BIGINT))) AS n FROM (SELECT DISTINCT intensity, aht, goal, wait FROM {loads} WHERE intensity > 0)",
        f"{prefix}probs": f"SELECT *, CASE WHEN n <= intensity THEN 1.0 ELSE (exp(n*ln(intensity)-lgamma(n+1)) * n/(n-intensity)) / "
        f"(list_sum(list_transform(range(0, n), lambda k: exp(k*ln(intensity)-lgamma(k+1)))) + exp(n*ln(intensity)-lgamma(n+1)) * n/(n-intensity)) END AS c FROM {prefix}cand",
        f"{prefix}levels": f"SELECT *, CASE WHEN n <= intensity THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - c*exp(-(n-intensity)*wait/aht))) END AS sl, "
        f"CASE WHEN n > intensity THEN c*aht/(n-intensity) END AS asa FROM {prefix}probs",
        f"{prefix}solved": f"SELECT intensity, aht, goal, wait, min(n) AS raw_agents, arg_min(sl, n) AS service_level, arg_min(asa, n) AS asa "
        f"FROM {prefix}levels WHERE sl >= goal GROUP BY ALL",
    }


def staffed_ctes(volumes: str, keys: str, goal: str = "0.8::DOUBLE", wait: str = "20.0::DOUBLE",
                 shrink: str = "0.30::DOUBLE", aht_factor: str = "1.0::DOUBLE") -> dict[str, str]:
    """CTEs ending in ``staffed``: the long plan of ``volumes(keys, task, ts, volume)``."""
    loads = (
        f"SELECT v.*, volume*(aht_min*{aht_factor})/60.0/concurrency AS intensity, aht_min*{aht_factor}*60 AS aht, "
        f"{goal} AS goal, {wait} AS wait, {shrink} AS shrink FROM ({volumes}) v JOIN params USING (task)"
    )
    return {
        "params": PARAMS,
        "loads": loads,
        **solver("loads"),
        "staffed": f"SELECT {keys}, l.ts, l.volume, l.intensity, coalesce(s.raw_agents, 0) AS raw_agents, "
        "CASE WHEN l.intensity > 0 THEN ceil(s.raw_agents / (1.0::DOUBLE - shrink)) ELSE 0 END AS agents, "
        "CASE WHEN l.intensity > 0 THEN l.intensity / s.raw_agents ELSE 0 END AS occupancy, "
        "CASE WHEN l.intensity > 0 THEN s.service_level ELSE 1 END AS service_level, "
        "CASE WHEN l.intensity > 0 THEN s.asa ELSE 0 END AS asa "
        "FROM loads l LEFT JOIN solved s USING (intensity, aht, goal, wait)",
    }


OPEN = "hour(ts) >= 8 AND hour(ts) < 20"

# --- flagship: events -> hourly -> dense -> naive next day -> plan -> daily --

_next_day = (
    "SELECT site, task, ts + INTERVAL 168 HOUR AS ts, volume FROM workload, bounds "
    f"WHERE ts > hi - INTERVAL 168 HOUR AND ts <= hi - INTERVAL 144 HOUR"
)
_wide_plan = (
    "SELECT site, ts, sum(volume) AS total_volume, sum(agents) AS total_agents, "
    + ", ".join(
        f"max(volume) FILTER (task='{k}' AND volume>0) AS {k}_volume, max(agents) FILTER (task='{k}' AND volume>0) AS {k}_agents"
        for k in TASKS
    )
    + " FROM staffed GROUP BY site, ts"
)


def next_day_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = base.records(spark, sf_dir)
    bounds = hourly.time_bounds(raw).withColumn("origin", F.col("hi") + clock.hours(1))
    dense = hourly.densify(hourly.aggregate_hourly(raw, SERIES), SERIES, ["volume"], bounds, carry=("origin",))
    ahead = forecast.repeat_last_week(dense, SERIES, 24, dense)
    return capacity.hourly_plan(ahead.withColumnRenamed("yhat", "volume"), ["site"])


@catalog.query(
    "next_day_staffing",
    cte("workload", **staffed_ctes(f"SELECT * FROM ({_next_day}) WHERE {OPEN}", "l.site, l.task"), plan=_wide_plan)
    + f"SELECT site, {d('ts')}, {r('sum(total_volume)', 'total_volume')}, {i('max(total_agents)', 'peak_agents')}, "
    + r("avg(total_agents)", "avg_agents")
    + ", "
    + ", ".join(
        r(f"coalesce(sum({k}_volume), 0)", f"{k}_volume") + ", " + i(f"max({k}_agents)", f"{k}_agents_peak")
        for k in TASKS
    )
    + " FROM plan GROUP BY site, ts::DATE",
)
def next_day_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, dense series, seasonal-naive next day, Erlang plan, daily roll-up."""
    return capacity.daily_plan(next_day_plan(spark, sf_dir), ["site"])


# --- long plan and its roll-ups over the whole workload ---------------------

_all = f"SELECT * FROM workload_all WHERE {OPEN} AND volume > 0"
_staffed_all = staffed_ctes(_all, "l.task")


@catalog.query(
    "task_staffing",
    cte("workload_all", **_staffed_all)
    + f"SELECT task, {t()}, {r('volume', 'volume')}, {r('intensity', 'intensity')}, {i('raw_agents', 'raw_agents')}, "
    f"{i('agents', 'agents')}, {r('occupancy', 'occupancy')}, {r('service_level', 'service_level')}, {r('asa', 'asa')}, coalesce(service_level >= 0.8, false) AS goal_met FROM staffed",
)
def task_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, agents, occupancy, service level and wait per task and opening hour."""
    return capacity.task_plan(base.workload_all(spark, sf_dir)).drop("aht_min", "concurrency")


@catalog.query("task_staffing_deduped", catalog.sql["task_staffing"])
def task_staffing_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan with each distinct load solved once and joined back."""
    return capacity.task_plan(base.workload_all(spark, sf_dir), dedupe=True).drop("aht_min", "concurrency")


_plan_volumes = f"SELECT task, ts, volume FROM workload_all WHERE {OPEN}"
_plan_ctes = staffed_ctes(_plan_volumes, "l.task")
_plan = (
    "SELECT ts, sum(volume) AS total_volume, sum(agents) AS total_agents, "
    + ", ".join(
        f"max({c}) FILTER (task='{k}' AND volume>0) AS {k}_{c}"
        for k in TASKS
        for c in ("volume", "agents", "occupancy", "service_level")
    )
    + " FROM staffed GROUP BY ts"
)


def plan_parts() -> dict[str, str]:
    """The fragments of ``plan``, over ``workload_all``."""
    return {**_plan_ctes, "plan": _plan}


def plan_sql(body: str, **extra: str) -> str:
    return cte("workload_all", **plan_parts(), **extra) + body


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.hourly_plan_from_wide(base.wide(spark, sf_dir), [])


@catalog.query(
    "hourly_staffing_plan",
    plan_sql(
        f"SELECT {t()}, {r('total_volume', 'total_volume')}, {i('total_agents', 'total_agents')}, "
        + ", ".join(
            f"{r(k + '_volume', k + '_volume')}, {i(k + '_agents', k + '_agents')}, {r(k + '_occupancy', k + '_occupancy')}, "
            + r(k + "_service_level", k + "_service_level")
            for k in TASKS
        )
        + f", {i('hour(ts)', 'hour')}, {i('isodow(ts) - 1', 'day_of_week')}, {d('ts')} FROM plan"
    ),
)
def hourly_staffing_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir)


@catalog.query(
    "daily_staffing",
    plan_sql(
        f"SELECT {d('ts')}, {r('sum(total_volume)', 'total_volume')}, {i('max(total_agents)', 'peak_agents')}, {r('avg(total_agents)', 'avg_agents')}, "
        + ", ".join(
            r(f"coalesce(sum({k}_volume), 0)", f"{k}_volume") + ", " + i(f"max({k}_agents)", f"{k}_agents_peak")
            for k in TASKS
        )
        + " FROM plan GROUP BY ts::DATE"
    ),
)
def daily_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.daily_plan(plan(spark, sf_dir), [])


@catalog.query(
    "weekly_staffing",
    plan_sql(
        f"SELECT {i('isoyear(ts)', 'iso_year')}, {i('weekofyear(ts)', 'week')}, {r('sum(total_volume)', 'total_volume')}, "
        f"{i('max(total_agents)', 'peak_agents')}, {r('round_even(avg(total_agents), 1)', 'avg_agents')} FROM plan GROUP BY isoyear(ts), weekofyear(ts)"
    ),
)
def weekly_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.weekly_plan(plan(spark, sf_dir), [])


@catalog.query(
    "shift_staffing",
    plan_sql(
        f"SELECT {d('ts')}, CASE WHEN hour(ts) < 16 THEN '08:00-16:00' ELSE '16:00-20:00' END AS shift, "
        f"{r('sum(total_volume)', 'total_volume')}, {i('max(total_agents)', 'peak_agents')}, {r('avg(total_agents)', 'avg_agents')}, "
        f"{i('ceil((max(total_agents) + avg(total_agents)) / 2)', 'recommended_headcount')} FROM plan GROUP BY ts::DATE, shift"
    ),
)
def shift_staffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.shift_plan(plan(spark, sf_dir), [])


@catalog.query(
    "staffing_summary",
    plan_sql(
        f"SELECT {r('sum(total_agents)', 'total_fte_hours')}, {i('max(total_agents)', 'peak_agents')}, {r('avg(total_agents)', 'avg_agents')} FROM plan"
    ),
)
def staffing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capacity.summary(plan(spark, sf_dir))


_request = staffed_ctes(f"SELECT site, task, ts, volume FROM workload WHERE {OPEN}", "l.site, l.task",
                        goal="0.9::DOUBLE", wait="30.0::DOUBLE", shrink="0.25::DOUBLE", aht_factor="1.0::DOUBLE")


@catalog.query(
    "staffing_request",
    cte("workload", **_request, totals="SELECT site, ts, sum(agents) AS total_agents FROM staffed GROUP BY ALL")
    + f"SELECT site, {r('sum(total_agents)', 'total_fte_hours')}, {i('max(total_agents)', 'peak_agents')}, {r('avg(total_agents)', 'avg_agents')} "
    "FROM totals GROUP BY site",
)
def staffing_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan with service level, wait and shrinkage of a request instead of the defaults."""
    config = CAPACITY.override(service_level=0.9, wait_seconds=30.0, shrinkage=0.25)
    staffed = capacity.hourly_plan(base.workload(spark, sf_dir), ["site"], config)
    return capacity.summary(staffed, ["site"])


@catalog.query(
    "erlang_agent_sweep",
    cte(
        "workload_all",
        params=PARAMS,
        loads="SELECT task, aht_min, max(volume)*aht_min/60.0/concurrency AS intensity FROM workload_all JOIN params USING (task) GROUP BY task, aht_min, concurrency",
        sweep="SELECT *, unnest(range(floor(intensity)::BIGINT, floor(intensity)::BIGINT + 10)) AS agents FROM loads",
        waits="SELECT *, aht_min*60 AS aht, CASE WHEN agents <= 0 THEN 0.0 WHEN intensity >= agents THEN 1.0 ELSE (exp(agents*ln(intensity)-lgamma(agents+1)) * agents/(agents-intensity)) / "
        "(list_sum(list_transform(range(0, agents), lambda k: exp(k*ln(intensity)-lgamma(k+1)))) + exp(agents*ln(intensity)-lgamma(agents+1)) * agents/(agents-intensity)) END AS c FROM sweep",
    )
    + f"SELECT task, {r('intensity', 'intensity')}, agents, {r('c', 'wait_probability')}, "
    f"{r('CASE WHEN agents > intensity THEN c*aht/(agents-intensity) END', 'asa')}, "
    f"{r('CASE WHEN agents <= intensity THEN 0 ELSE greatest(0, least(1, 1 - c*exp(-(agents-intensity)*20/aht))) END', 'service_level')} FROM waits",
)
def erlang_agent_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue figures around the busiest hour of each task."""
    busiest = base.workload_all(spark, sf_dir).groupBy("task").agg(F.max("volume").alias("volume"))
    loads = capacity.with_task_params(busiest).withColumn(
        "intensity", F.col("volume") * F.col("aht_min") / F.lit(60.0) / F.col("concurrency")
    )
    return capacity.agent_sweep(loads).select(
        "task", "intensity", "agents", "wait_probability", "asa", "service_level"
    )
