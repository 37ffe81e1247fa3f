"""What-if scenarios: all of them planned in one job.

Scenarios are a short literal list. Each row of the forecast is repeated once
per scenario by ``explode``, so no join is involved.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CAPACITY, CapacityConfig
from ..functions import clock
from ..functions.numbers import ratio
from . import capacity

DEFAULT_COST = 25.0


@dataclass(frozen=True)
class Scenario:
    name: str
    volume_multiplier: float = 1.0
    aht_multiplier: float = 1.0
    service_level: float = 0.80
    shrinkage: float = 0.30
    custom: dict[str, float] = field(default_factory=dict)

    @classmethod
    def from_pct(cls, name: str, volume_pct: float = 0, aht_pct: float = 0, **rest) -> "Scenario":
        return cls(name, 1 + volume_pct / 100, 1 + aht_pct / 100, **rest)


BASE = Scenario("Base")

# Names and factors of the scenario templates.
PREDEFINED = (
    Scenario.from_pct("Peak Season (+30%)", 30),
    Scenario.from_pct("Low Season (-20%)", -20),
    Scenario.from_pct("New Product Launch", 50, 20),
    Scenario.from_pct("Efficiency Improvement", 0, -10),
    Scenario.from_pct("Crisis Response", 100, 50),
    Scenario.from_pct("Email Shift", custom={"calls": 0.8, "emails": 1.2}),
)


def _literal(s: Scenario) -> Column:
    custom = F.map_from_entries(
        F.array(*[F.struct(F.lit(k), F.lit(float(v))) for k, v in s.custom.items()])
    ) if s.custom else F.lit(None).cast("map<string,double>")
    return F.struct(
        F.lit(s.name).alias("scenario"),
        F.lit(float(s.volume_multiplier)).alias("volume_multiplier"),
        F.lit(float(s.aht_multiplier)).alias("aht_multiplier"),
        F.lit(float(s.service_level)).alias("goal"),
        F.lit(float(s.shrinkage)).alias("shrinkage"),
        custom.alias("custom"),
    )


def apply(forecast: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """The forecast once per scenario, volumes scaled, with the scenario's columns."""
    s = F.explode(F.array(*[_literal(x) for x in scenarios])).alias("_s")
    factor = F.coalesce(F.try_element_at("custom", F.col("task")), F.lit(1.0))
    return (
        forecast.select("*", s).select(*forecast.columns, "_s.*")
        .withColumn("volume", F.col("volume") * F.col("volume_multiplier") * factor)
        .drop("custom")
    )


def plan(
    forecast: DataFrame, scenarios: list[Scenario], mode: str = "replan", config: CapacityConfig = CAPACITY
) -> DataFrame:
    """Long plan per scenario, task and hour with ``agents`` as a double.

    ``replan`` solves the queue under each scenario's handling time, service
    level and shrinkage. ``scale`` plans with the defaults and then multiplies
    the agents by the handling-time and shrinkage factors, each once.
    """
    rows = apply(forecast, scenarios).filter(
        clock.is_working_hour("ts", config.open_hour, config.close_hour)
    ).filter("volume > 0")
    with_params = capacity.with_task_params(rows, config)
    if mode == "replan":
        with_params = with_params.withColumn("aht_min", F.col("aht_min") * F.col("aht_multiplier"))
        staffed = capacity.staff(with_params, goal=F.col("goal"), shrinkage=F.col("shrinkage"), config=config)
        return staffed.withColumn("agents", F.col("agents").cast("double"))
    if mode != "scale":
        raise ValueError(f"unknown mode {mode!r}")
    staffed = capacity.staff(with_params, config=config)
    factor = F.col("aht_multiplier") * (F.lit(1 - config.shrinkage) / (1 - F.col("shrinkage")))
    return staffed.withColumn("agents", F.col("agents") * factor)


def results(
    forecast: DataFrame,
    scenarios: list[Scenario],
    keys: list[str] | None = None,
    mode: str = "replan",
    cost_per_hour: float = DEFAULT_COST,
    config: CapacityConfig = CAPACITY,
) -> DataFrame:
    """Agent hours, peak, mean and cost per scenario."""
    keys = keys or []
    hourly = plan(forecast, scenarios, mode, config).groupBy(*keys, "scenario", "ts").agg(
        F.sum("agents").alias("total_agents")
    )
    return hourly.groupBy(*keys, "scenario").agg(
        F.sum("total_agents").alias("total_fte"),
        F.floor(F.max("total_agents")).cast("bigint").alias("peak_agents"),
        F.avg("total_agents").alias("avg_agents"),
        (F.sum("total_agents") * cost_per_hour).alias("cost"),
    )


def compare(result: DataFrame, base: str = "Base", keys: list[str] | None = None) -> DataFrame:
    """Each scenario beside the base of its keys, differences in percent.

    A key without the base has NULL differences.
    """
    keys = keys or []
    reference = result.filter(F.col("scenario") == base).select(
        *keys, F.col("total_fte").alias("_fte"), F.col("cost").alias("_cost")
    )
    # Without keys the reference is one row.
    beside = result.join(reference, keys, "left") if keys else result.crossJoin(F.broadcast(reference))
    return beside.select(
        *result.columns,
        ((ratio(F.col("total_fte"), F.col("_fte")) - 1) * 100).alias("fte_vs_base_pct"),
        ((ratio(F.col("cost"), F.col("_cost")) - 1) * 100).alias("cost_vs_base_pct"),
    )


def sweep(parameter: str, values: list[float]) -> list[Scenario]:
    """One scenario per value: percent changes for volume and aht, shares for the rest."""
    def one(v: float) -> Scenario:
        named = replace(BASE, name=f"{v:g}")
        if parameter == "volume":
            return replace(named, volume_multiplier=1 + v / 100)
        if parameter == "aht":
            return replace(named, aht_multiplier=1 + v / 100)
        if parameter == "shrinkage":
            return replace(named, shrinkage=v)
        if parameter == "service_level":
            return replace(named, service_level=v)
        raise ValueError(f"unknown parameter {parameter!r}")

    return [one(v) for v in values]


# Default levels of the service-level trade-off.
SERVICE_LEVELS = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def sensitivity(
    forecast: DataFrame, parameter: str, values: list[float], keys: list[str] | None = None, mode: str = "replan",
    cost_per_hour: float = DEFAULT_COST,
) -> DataFrame:
    out = results(forecast, sweep(parameter, values), keys, mode, cost_per_hour)
    return out.withColumn("value", F.col("scenario").cast("double")).drop("scenario")


def nearest_to(swept: DataFrame, base_value: float, keys: list[str] | None = None) -> DataFrame:
    """The sweep point next to the base value, per key; the first of several."""
    keys = keys or []
    distance = F.struct(F.abs(F.col("value") - base_value), F.col("value"))
    nearest = F.min_by(F.struct("value", "total_fte", "cost"), distance).alias("_p")
    return swept.groupBy(*keys).agg(nearest).select(*keys, "_p.*")


def pattern(planned: DataFrame, part: str = "hour") -> DataFrame:
    """Mean total agents per scenario and hour or weekday."""
    label = {"hour": F.hour("ts"), "weekday": F.weekday("ts")}[part]
    totals = planned.groupBy("scenario", "ts").agg(F.sum("agents").alias("total_agents"))
    return totals.groupBy("scenario", label.alias(part)).agg(F.avg("total_agents").alias("avg_agents"))
