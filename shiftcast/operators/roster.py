"""Centres and agents: nested roster to flat rows, totals and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The nested document: centre id -> centre with its agents by id.
AGENT = "struct<id:string,name:string,fte:double,is_active:boolean,created_at:string>"
CENTRE = f"struct<id:string,name:string,cost_per_agent_hour:double,created_at:string,agents:map<string,{AGENT}>>"
ROSTER = f"map<string,{CENTRE}>"

DEFAULT_COST = 25.0
HOURS_PER_DAY = 8
DAYS_PER_MONTH = 22


def from_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Flat ``(centre, centre_name, cost, agent, agent_name, fte, active)``.

    A missing cost, share or activity flag takes its default; a centre without
    agents yields one row without an agent.
    """
    centres = documents.select(F.explode(F.from_json(column, ROSTER)).alias("centre", "c"))
    return centres.select(
        "centre",
        F.col("c.name").alias("centre_name"),
        F.coalesce(F.col("c.cost_per_agent_hour"), F.lit(DEFAULT_COST)).alias("cost"),
        F.explode_outer("c.agents").alias("agent", "a"),
    ).select(
        "centre", "centre_name", "cost", "agent",
        F.col("a.name").alias("agent_name"),
        F.when(F.col("agent").isNotNull(), F.coalesce(F.col("a.fte"), F.lit(1.0))).alias("fte"),
        F.when(F.col("agent").isNotNull(), F.coalesce(F.col("a.is_active"), F.lit(True))).alias("active"),
    )


def to_json(flat: DataFrame) -> DataFrame:
    """One ``(centre, json)`` document per centre. A centre's agents are gathered
    into one value, as many as the centre employs."""
    agent = F.struct(
        F.col("agent").alias("id"), F.col("agent_name").alias("name"), "fte", F.col("active").alias("is_active")
    )
    centres = flat.groupBy("centre", "centre_name", "cost").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("agent").isNotNull(), F.struct("agent", agent)))).alias("agents")
    )
    body = F.struct(
        F.col("centre").alias("id"), F.col("centre_name").alias("name"),
        F.col("cost").alias("cost_per_agent_hour"), "agents",
    )
    return centres.select("centre", F.to_json(F.create_map("centre", body)).alias("json"))


def _active_fte():
    return F.coalesce(F.sum(F.when(F.col("active"), F.col("fte"))), F.lit(0.0))


def totals(flat: DataFrame) -> DataFrame:
    return flat.agg(
        F.count_distinct("centre").alias("centres"),
        F.count("agent").alias("agents"),
        F.count_if(F.col("active")).alias("active_agents"),
        _active_fte().alias("active_fte"),
    )


def by_centre(flat: DataFrame) -> DataFrame:
    """Agents, active share and hourly, daily and monthly cost of each centre."""
    return (
        flat.groupBy("centre", "cost")
        .agg(
            F.count("agent").alias("agents"),
            F.count_if(F.col("active")).alias("active_agents"),
            _active_fte().alias("active_fte"),
        )
        .withColumn("hourly_cost", F.col("active_fte") * F.col("cost"))
        .withColumn("daily_cost", F.col("hourly_cost") * HOURS_PER_DAY)
        .withColumn("monthly_cost", F.col("daily_cost") * DAYS_PER_MONTH)
    )
