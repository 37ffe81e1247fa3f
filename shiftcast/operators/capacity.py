"""Staffing: offered load, agents by Erlang C, hourly, daily and shift plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CAPACITY, TASKS, CapacityConfig
from ..functions import clock, erlang
from .hourly import wide_to_long


def task_params(spark: SparkSession, config: CapacityConfig = CAPACITY) -> DataFrame:
    """One row per task; as many rows as the configuration names."""
    rows = [(t, float(aht), float(conc)) for t, (aht, conc) in config.tasks.items()]
    return spark.createDataFrame(rows, "task string, aht_min double, concurrency double")


def with_task_params(df: DataFrame, config: CapacityConfig = CAPACITY) -> DataFrame:
    """Adds ``aht_min`` and ``concurrency``; rows of unknown tasks are dropped."""
    return df.join(F.broadcast(task_params(df.sparkSession, config)), "task")


def staff(
    df: DataFrame,
    goal: Column | float | None = None,
    target: Column | float | None = None,
    shrinkage: Column | float | None = None,
    config: CapacityConfig = CAPACITY,
    dedupe: bool = False,
) -> DataFrame:
    """Adds intensity, raw_agents, agents, occupancy, service_level, asa and goal_met.

    Where not even ``max_agents`` reach the goal they are the answer and ``goal_met`` is false.
    Expects ``volume``, ``aht_min`` and ``concurrency``. The fold that finds the
    agent count runs inside the scan's stage, row by row, because forecasts are
    real numbers and rarely repeat. ``dedupe=True`` solves each distinct load
    once and joins it back, which pays off when volumes are small counts.
    """

    def col(x, default) -> Column:
        x = default if x is None else x
        return x if isinstance(x, Column) else F.lit(float(x))

    prepared = (
        df.withColumn(
            "intensity",
            erlang.traffic_intensity(F.col("volume"), F.col("aht_min"), config.interval_minutes)
            / F.col("concurrency"),
        )
        .withColumn("_aht", F.col("aht_min") * 60)
        .withColumn("_goal", col(goal, config.service_level))
        .withColumn("_target", col(target, config.wait_seconds))
        .withColumn("_shrink", col(shrinkage, config.shrinkage))
    )
    load = ["intensity", "_aht", "_goal", "_target"]
    solution = erlang.solve_agents(*[F.col(c) for c in load], max_agents=config.max_agents)
    if dedupe:
        solved = prepared.select(*load).distinct().withColumn("_sol", solution)
        prepared = prepared.join(solved, load)
    else:
        prepared = prepared.withColumn("_sol", solution)
    n, c, a = F.col("_sol.n"), F.col("_sol.c"), F.col("intensity")
    busy = a > 0
    return (
        prepared.withColumn("raw_agents", n)
        .withColumn(
            "agents",
            F.when(busy, F.ceil(n / (F.lit(1.0) - F.col("_shrink")))).otherwise(F.lit(0)).cast("int"),
        )
        .withColumn("occupancy", F.when(busy, a / n).otherwise(F.lit(0.0)))
        .withColumn(
            "service_level",
            F.when(busy, erlang.service_level(c, n, a, F.col("_aht"), F.col("_target"))).otherwise(F.lit(1.0)),
        )
        .withColumn(
            "asa", F.when(busy, erlang.wait_seconds(c, n, a, F.col("_aht"))).otherwise(F.lit(0.0))
        )
        .withColumn("goal_met", ~busy | (n < config.max_agents) | (F.col("service_level") >= F.col("_goal")))
        .drop("_aht", "_goal", "_target", "_shrink", "_sol")
    )


def task_plan(df: DataFrame, config: CapacityConfig = CAPACITY, **options) -> DataFrame:
    """Staffing per task row of a long forecast inside the opening hours, volume > 0."""
    inside = df.filter(clock.is_working_hour("ts", config.open_hour, config.close_hour)).filter("volume > 0")
    return staff(with_task_params(inside, config), config=config, **options)


def hourly_plan(
    forecast: DataFrame, keys: list[str], config: CapacityConfig = CAPACITY, **options
) -> DataFrame:
    """Wide plan: totals and per-task volume, agents, occupancy and service level.

    Every opening hour of the forecast appears, also those without any volume,
    whose totals are 0 and whose task columns are NULL.
    """
    inside = forecast.filter(clock.is_working_hour("ts", config.open_hour, config.close_hour))
    present = inside.withColumn("volume", F.greatest(F.col("volume"), F.lit(0.0)))
    staffed = staff(with_task_params(present, config), config=config, **options)
    return _widen(staffed, keys, list(config.tasks))


def hourly_plan_from_wide(
    forecast: DataFrame, keys: list[str], config: CapacityConfig = CAPACITY, **options
) -> DataFrame:
    """As :func:`hourly_plan` for a forecast with one volume column per task."""
    return hourly_plan(wide_to_long(forecast, keys, keep_zero=True), keys, config, **options)


def _widen(staffed: DataFrame, keys: list[str], tasks: list[str]) -> DataFrame:
    per_task = []
    for t in tasks:
        mine = (F.col("task") == t) & (F.col("volume") > 0)
        for out, source in (
            ("volume", "volume"), ("agents", "agents"),
            ("occupancy", "occupancy"), ("service_level", "service_level"),
        ):
            per_task.append(F.max(F.when(mine, F.col(source))).alias(f"{t}_{out}"))
    return (
        staffed.groupBy(*keys, "ts")
        .agg(
            F.sum("volume").alias("total_volume"),
            F.sum("agents").cast("bigint").alias("total_agents"),
            *per_task,
        )
        .withColumn("hour", F.hour("ts"))
        .withColumn("day_of_week", F.weekday("ts"))
        .withColumn("date", F.to_date("ts"))
    )


def hourly_totals(staffed: DataFrame, keys: list[str]) -> DataFrame:
    """Total volume and agents per hour of a long plan."""
    return staffed.groupBy(*keys, "ts").agg(
        F.sum("volume").alias("total_volume"), F.sum("agents").cast("bigint").alias("total_agents")
    )


def daily_plan(plan: DataFrame, keys: list[str], tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Volume sum, peak and mean agents per day, with task sums and peaks, in one aggregation."""
    present = [t for t in tasks if f"{t}_volume" in plan.columns]
    return plan.groupBy(*keys, F.to_date("ts").alias("date")).agg(
        F.sum("total_volume").alias("total_volume"),
        F.max("total_agents").alias("peak_agents"),
        F.avg("total_agents").alias("avg_agents"),
        *[F.coalesce(F.sum(f"{t}_volume"), F.lit(0.0)).alias(f"{t}_volume") for t in present],
        *[F.max(f"{t}_agents").alias(f"{t}_agents_peak") for t in present],
    )


def weekly_plan(plan: DataFrame, keys: list[str], merge_years: bool = False) -> DataFrame:
    """Totals per ISO week; ``merge_years`` drops the year from the key."""
    week = [F.weekofyear("ts").alias("week")]
    if not merge_years:
        week.insert(0, clock.iso_year("ts").alias("iso_year"))
    return plan.groupBy(*keys, *week).agg(
        F.sum("total_volume").alias("total_volume"),
        F.max("total_agents").alias("peak_agents"),
        F.bround(F.avg("total_agents"), 1).alias("avg_agents"),
    )


def shift_plan(
    plan: DataFrame, keys: list[str], length: int = 8, config: CapacityConfig = CAPACITY
) -> DataFrame:
    label = clock.shift_label("ts", length, config.open_hour, config.close_hour)
    return (
        plan.groupBy(*keys, F.to_date("ts").alias("date"), label.alias("shift"))
        .agg(
            F.sum("total_volume").alias("total_volume"),
            F.max("total_agents").alias("peak_agents"),
            F.avg("total_agents").alias("avg_agents"),
        )
        .withColumn(
            "recommended_headcount",
            F.ceil((F.col("peak_agents") + F.col("avg_agents")) / 2).cast("bigint"),
        )
    )


def summary(plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Total agent hours, peak and mean agents of a plan."""
    return plan.groupBy(*(keys or [])).agg(
        F.coalesce(F.sum("total_agents"), F.lit(0)).cast("double").alias("total_fte_hours"),
        F.max("total_agents").alias("peak_agents"),
        F.avg("total_agents").alias("avg_agents"),
    )


def agent_sweep(df: DataFrame, target: float = 20.0, steps: int = 10) -> DataFrame:
    """Waiting probability, wait and service level for ``steps`` agent counts from ⌊a⌋ on.

    Expects ``intensity`` and ``aht_min``.
    """
    a, aht = F.col("intensity"), F.col("aht_min") * 60
    base = F.floor(a).cast("int")
    return (
        df.withColumn("agents", F.explode(F.sequence(base, base + (steps - 1))))
        .withColumn("wait_probability", erlang.wait_probability(F.col("agents"), a))
        .withColumn("asa", erlang.wait_seconds(F.col("wait_probability"), F.col("agents"), a, aht))
        .withColumn(
            "service_level",
            erlang.service_level(F.col("wait_probability"), F.col("agents"), a, aht, F.lit(target)),
        )
    )
