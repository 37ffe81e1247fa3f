"""Scenario queries over the workload of all sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scenarios
from ..operators.scenarios import BASE, PREDEFINED, SERVICE_LEVELS
from . import base
from .base import Catalog, cte, i, r
from .staffing import OPEN, PARAMS, solver

catalog = Catalog()


def _values(items) -> str:
    rows = ", ".join(
        f"('{s.name}', {s.volume_multiplier!r}::DOUBLE, {s.aht_multiplier!r}::DOUBLE, {s.service_level!r}::DOUBLE, {s.shrinkage!r}::DOUBLE, "
        f"{s.custom.get('calls', 1.0)!r}::DOUBLE, {s.custom.get('emails', 1.0)!r}::DOUBLE)"
        for s in items
    )
    return f"SELECT * FROM (VALUES {rows}) s(scenario, vm, am, sl, sh, cc, ce)"


def planned_ctes(items, mode: str, source: str = "workload_all", keys: str = "") -> dict[str, str]:
    """``keys`` are the key columns of the source, each followed by a comma."""
    aht = "aht_min*am" if mode == "replan" else "aht_min"
    goal = "sl" if mode == "replan" else "0.8::DOUBLE"
    agents = "ceil(raw_agents/(1.0::DOUBLE-sh))" if mode == "replan" else "ceil(raw_agents/(1.0::DOUBLE-0.3::DOUBLE))*(am*((1-0.3::DOUBLE)/(1-sh)))"
    return {
        "sc": _values(items),
        "params": PARAMS,
        "vol": f"SELECT sc.*, {keys} w.task, w.ts, w.volume*vm*(CASE task WHEN 'calls' THEN cc WHEN 'emails' THEN ce ELSE 1 END) AS volume FROM (SELECT * FROM {source} WHERE {OPEN} AND volume > 0) w, sc",
        "loads": f"SELECT v.*, volume*({aht})/60.0::DOUBLE/concurrency AS intensity, ({aht})*60 AS aht, {goal} AS goal, 20.0::DOUBLE AS wait FROM vol v JOIN params USING (task)",
        **solver("loads"),
        "hourly_s": f"SELECT {keys} scenario, ts, sum({agents}) AS total_agents FROM loads JOIN solved USING (intensity, aht, goal, wait) GROUP BY {keys} scenario, ts",
        "res": f"SELECT {keys} scenario, sum(total_agents) AS total_fte, floor(max(total_agents))::BIGINT AS peak_agents, avg(total_agents) AS avg_agents, sum(total_agents)*25.0::DOUBLE AS cost FROM hourly_s GROUP BY {keys} scenario",
    }


_RESULT = f"{r('total_fte', 'total_fte')}, peak_agents, {r('avg_agents', 'avg_agents')}, {r('cost', 'cost')}"
ALL = [BASE, *PREDEFINED]

for _mode in ("replan", "scale"):

    @catalog.query(f"scenarios_{_mode}", cte("workload_all", **planned_ctes(ALL, _mode)) + f"SELECT scenario, {_RESULT} FROM res")
    def run(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        """Hours, peak, mean and cost of the base and the six templates."""
        return scenarios.results(base.workload_all(spark, sf_dir), ALL, mode=mode)


@catalog.query(
    "scenario_comparison",
    cte("workload_all", **planned_ctes(ALL, "replan"), b="SELECT total_fte AS bf, cost AS bc FROM res WHERE scenario = 'Base'")
    + f"SELECT scenario, {_RESULT}, {r('(total_fte/bf-1)*100', 'fte_vs_base_pct')}, {r('(cost/bc-1)*100', 'cost_vs_base_pct')} FROM res, b",
)
def scenario_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.compare(scenarios.results(base.workload_all(spark, sf_dir), ALL))


@catalog.query(
    "scenario_comparison_by_site",
    cte("workload", **planned_ctes(ALL, "replan", "workload", "site,"), b="SELECT site, total_fte AS bf, cost AS bc FROM res WHERE scenario = 'Base'")
    + f"SELECT site, scenario, {_RESULT}, {r('(total_fte/bf-1)*100', 'fte_vs_base_pct')}, {r('(cost/bc-1)*100', 'cost_vs_base_pct')} FROM res JOIN b USING (site)",
)
def scenario_comparison_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site's scenarios beside its own base."""
    return scenarios.compare(scenarios.results(base.workload(spark, sf_dir), ALL, ["site"]), keys=["site"])


SWEEPS = {"volume": [-20.0, -10.0, 0.0, 10.0, 20.0], "aht": [-20.0, 0.0, 20.0], "shrinkage": [0.2, 0.3, 0.4]}
for _parameter, _steps in SWEEPS.items():

    @catalog.query(
        f"sensitivity_{_parameter}",
        cte("workload_all", **planned_ctes(scenarios.sweep(_parameter, _steps), "replan")) + f"SELECT {r('scenario', 'value')}, {_RESULT} FROM res",
    )
    def sensitivity(spark: SparkSession, sf_dir: str, parameter: str = _parameter, steps=tuple(_steps)) -> DataFrame:
        return scenarios.sensitivity(base.workload_all(spark, sf_dir), parameter, list(steps))


@catalog.query(
    "sensitivity_nearest_base",
    cte("workload_all", **planned_ctes(scenarios.sweep("volume", [-8.0, 7.0, 20.0]), "replan"))
    + f"SELECT {r('scenario', 'value')}, {r('total_fte', 'total_fte')}, {r('cost', 'cost')} FROM res WHERE scenario = '7'",
)
def sensitivity_nearest_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of a volume sweep that lies next to no change."""
    return scenarios.nearest_to(scenarios.sensitivity(base.workload_all(spark, sf_dir), "volume", [-8.0, 7.0, 20.0]), 0.0)


@catalog.query(
    "sensitivity_nearest_base_by_site",
    cte("workload", **planned_ctes(scenarios.sweep("volume", [-8.0, 7.0, 20.0]), "replan", "workload", "site,"))
    + f"SELECT site, {r('scenario', 'value')}, {r('total_fte', 'total_fte')}, {r('cost', 'cost')} FROM res WHERE scenario = '7'",
)
def sensitivity_nearest_base_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    swept = scenarios.sensitivity(base.workload(spark, sf_dir), "volume", [-8.0, 7.0, 20.0], ["site"])
    return scenarios.nearest_to(swept, 0.0, ["site"])


@catalog.query(
    "service_level_tradeoff",
    cte("workload_all", **planned_ctes(scenarios.sweep("service_level", list(SERVICE_LEVELS)), "replan"))
    + f"SELECT {r('scenario', 'value')}, {_RESULT} FROM res",
)
def service_level_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each service level; the level reaches the queue solver."""
    return scenarios.sensitivity(base.workload_all(spark, sf_dir), "service_level", list(SERVICE_LEVELS))


for _part, _expr in (("hour", "hour(ts)"), ("weekday", "isodow(ts)-1")):

    @catalog.query(
        f"scenario_pattern_by_{_part}",
        cte("workload_all", **planned_ctes(ALL, "replan")) + f"SELECT scenario, {i(_expr, _part)}, {r('avg(total_agents)', 'avg_agents')} FROM hourly_s GROUP BY scenario, {_expr}",
    )
    def pattern(spark: SparkSession, sf_dir: str, part: str = _part) -> DataFrame:
        return scenarios.pattern(scenarios.plan(base.workload_all(spark, sf_dir), ALL), part)
