"""Hourly tables, profiles, matrices, summaries, leads and roster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUSINESS_HOURS, VOLUME_COLUMNS
from ..functions import clock
from ..functions.numbers import display_name
from ..operators import capacity, hourly, leads, rollups, roster
from ..session import persist_to_shared
from . import base, staffing
from .base import SERIES, Catalog, cte, d, i, r, t
from .staffing import plan_sql

catalog = Catalog()

_HOUR = "date_trunc('hour', ts)"


@catalog.query("hourly_counts", cte("hourly") + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM hourly")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES)


@catalog.query("hourly_sum", cte("raw") + f"SELECT site, task, {t(_HOUR)}, {r('coalesce(sum(value), 0)', 'volume')} FROM raw GROUP BY site, task, {_HOUR}")
def hourly_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES, value="value", how="sum")


@catalog.query("hourly_mean", cte("raw") + f"SELECT task, {t(_HOUR)}, {r('avg(value)', 'volume')} FROM raw GROUP BY task, {_HOUR}")
def hourly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.aggregate_hourly(base.records(spark, sf_dir), ["task"], value="value", how="mean")


@catalog.query("dense_workload", cte("workload") + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM workload")
def dense_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.workload(spark, sf_dir)


@catalog.query(
    "dense_own_span",
    cte("hourly", span="SELECT site, task, min(ts) lo, max(ts) hi FROM hourly GROUP BY ALL",
        s="SELECT site, task, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span")
    + f"SELECT site, task, {t()}, {r('coalesce(volume, 0)', 'volume')} FROM s LEFT JOIN hourly USING (site, task, ts)",
)
def dense_own_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series from its own first to its own last hour."""
    return hourly.dense_hourly(base.records(spark, sf_dir), SERIES, common_span=False)


_WIDE = ", ".join(r(c, c) for c in (*VOLUME_COLUMNS, "outbound_total"))


@catalog.query("wide_workload", cte("wide") + f"SELECT {t()}, {_WIDE} FROM wide")
def wide_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly table with a column per task and the outbound total."""
    return base.wide(spark, sf_dir)


@catalog.query(
    "merged_tasks",
    cte("hourly", c="SELECT site, ts, volume AS call_volume FROM hourly WHERE task='calls'", e="SELECT site, ts, volume AS email_count FROM hourly WHERE task='emails'",
        o="SELECT site, ts, volume AS outbound_ook FROM hourly WHERE task='outbound_ook'")
    + f"SELECT site, {t()}, {r('coalesce(call_volume,0)', 'call_volume')}, {r('coalesce(email_count,0)', 'email_count')}, {r('coalesce(outbound_ook,0)', 'outbound_ook')} "
    "FROM c FULL JOIN e USING (site, ts) FULL JOIN o USING (site, ts)",
)
def merged_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separately loaded task tables joined on site and hour."""
    names = {"calls": "call_volume", "emails": "email_count", "outbound_ook": "outbound_ook"}
    loaded = [hourly.aggregate_hourly(base.records(spark, sf_dir, [k]), ["site"]) for k in names]
    frames = [h.withColumnRenamed("volume", v) for h, v in zip(loaded, names.values())]
    return hourly.merge_wide(frames, ["site"]).na.fill(0.0, list(names.values()))


@catalog.query(
    "outbound_pivot",
    cte("raw", o=f"SELECT site, {_HOUR} AS ts, upper(trim(replace(task, 'outbound_', ' '))) AS type, value FROM raw WHERE task LIKE 'outbound_%'")
    + f"SELECT site, {t()}, {r('coalesce(sum(value) FILTER (type=' + chr(39) + 'OOK' + chr(39) + '), 0)', 'outbound_ook')}, "
    f"{r('coalesce(sum(value) FILTER (type=' + chr(39) + 'OMK' + chr(39) + '), 0)', 'outbound_omk')}, "
    f"{r('coalesce(sum(value) FILTER (type=' + chr(39) + 'NB' + chr(39) + '), 0)', 'outbound_nb')}, {r('sum(value)', 'outbound_total')} FROM o GROUP BY site, ts",
)
def outbound_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour by outbound type; type values arrive padded and in any case."""
    o = base.records(spark, sf_dir, base.OUTBOUND).select(
        "site", clock.hour_floor("ts").alias("ts"),
        F.upper(F.trim(F.regexp_replace("task", "outbound_", " "))).alias("type"), F.col("value").alias("count"),
    )
    return hourly.pivot_types(o, ["site"], ["OOK", "OMK", "NB"])


@catalog.query(
    "wide_to_long",
    cte("workload_all") + f"SELECT task, {t()}, {r('volume', 'volume')} FROM workload_all WHERE volume > 0",
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.wide_to_long(base.wide(spark, sf_dir), [])


@catalog.query(
    "missing_hours",
    cte("hourly", span="SELECT site, task, min(ts) lo, max(ts) hi FROM hourly GROUP BY ALL",
        s="SELECT site, task, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span")
    + f"SELECT site, task, {t()} FROM s ANTI JOIN hourly USING (site, task, ts)",
)
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.missing_hours(hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES), SERIES)


@catalog.query(
    "date_range",
    cte("hourly") + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 23:00:00'",
)
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of three days; the range is pushed into the scan of the raw records."""
    inside = rollups.between(base.records(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-07 23:59:59.999999")
    return hourly.aggregate_hourly(inside, SERIES)


@catalog.query(
    "daily_totals",
    cte("hourly", span="SELECT site, task, min(ts)::DATE lo, max(ts)::DATE hi FROM hourly GROUP BY ALL",
        s="SELECT site, task, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS date FROM span",
        x="SELECT site, task, ts::DATE AS date, sum(volume) AS volume FROM hourly GROUP BY ALL")
    + f"SELECT site, task, {d()}, {r('coalesce(volume, 0)', 'volume')} FROM s LEFT JOIN x USING (site, task, date)",
)
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES)
    return rollups.daily_totals(h, SERIES, ["volume"])


@catalog.query(
    "hour_profile",
    cte("workload") + f"SELECT site, task, {i('hour(ts)', 'hour')}, {r('avg(volume)', 'volume')} FROM workload WHERE hour(ts) BETWEEN 7 AND 22 GROUP BY site, task, hour(ts)",
)
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.hour_profile(base.workload(spark, sf_dir), SERIES, ["volume"])


@catalog.query(
    "weekday_profile",
    cte("wide") + f"SELECT {i('isodow(ts)-1', 'day_of_week')}, dayname(any_value(ts)) AS day_name, {r('avg(call_volume)', 'call_volume')}, {r('avg(outbound_total)', 'outbound_total')} FROM wide GROUP BY isodow(ts)",
)
def weekday_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.weekday_profile(base.wide(spark, sf_dir), ["call_volume", "outbound_total"])


_IN_PLAN = range(8, 20)


def _cells(how: str, source: str = "total_agents") -> str:
    return ", ".join(
        r(how.format(f"{source}) FILTER (hour(ts) = {h}") if h in _IN_PLAN else "0", f"h{h:02d}") for h in BUSINESS_HOURS
    )


@catalog.query("agents_by_date_and_hour", plan_sql(f"SELECT {d('ts')}, {_cells('max({})')} FROM plan GROUP BY ts::DATE"))
def agents_by_date_and_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.date_hour_matrix(staffing.plan(spark, sf_dir), [])


@catalog.query(
    "agents_by_weekday_and_hour",
    plan_sql(f"SELECT {i('isodow(ts)-1', 'day_of_week')}, " + ", ".join(
        r(f"round_even(avg(total_agents) FILTER (hour(ts) = {h}), 1)" if h in _IN_PLAN else "0", f"h{h:02d}") for h in BUSINESS_HOURS
    ) + " FROM plan GROUP BY isodow(ts)"),
)
def agents_by_weekday_and_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.weekday_hour_matrix(staffing.plan(spark, sf_dir), [])


_LONG = "SELECT task, ts, agents FROM staffed WHERE volume > 0"


@catalog.query(
    "task_agents_by_weekday_and_hour",
    plan_sql(f"SELECT task, {i('isodow(ts)-1', 'day_of_week')}, " + ", ".join(
        r(f"round_even(avg(agents) FILTER (hour(ts) = {h}), 1)" if h in _IN_PLAN else "0", f"h{h:02d}") for h in BUSINESS_HOURS
    ) + " FROM lp GROUP BY task, isodow(ts)", lp=_LONG),
)
def task_agents_by_weekday_and_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = capacity.task_plan(base.workload_all(spark, sf_dir))
    return rollups.weekday_hour_matrix(long, ["task"], "agents")


_MATRIX = {
    "cells": "SELECT isodow(ts)-1 AS dow, hour(ts) AS hour, round_even(avg(total_agents), 1) AS a FROM plan GROUP BY ALL "
    "UNION ALL SELECT dow, h, 0 FROM (SELECT DISTINCT isodow(ts)-1 AS dow FROM plan), (VALUES (7),(20),(21),(22)) v(h)",
}


@catalog.query(
    "weekday_staffing_rows",
    plan_sql(f"SELECT {i('dow', 'day_of_week')}, {r('avg(a)', 'mean_agents')}, {r('max(a)', 'peak_agents')} FROM cells GROUP BY dow", **_MATRIX),
)
def weekday_staffing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.matrix_rows(rollups.weekday_hour_matrix(staffing.plan(spark, sf_dir), []))


@catalog.query(
    "weekly_roster_highlights",
    plan_sql(
        f"SELECT {r('max(a)', 'peak')}, {r('avg(a)', 'mean')}, (SELECT dow FROM (SELECT dow, avg(a) m FROM cells GROUP BY dow) ORDER BY m DESC, dow LIMIT 1)::BIGINT AS busiest_day, "
        "(SELECT hour FROM (SELECT hour, avg(a) m FROM cells GROUP BY hour) ORDER BY m DESC, hour LIMIT 1)::BIGINT AS peak_hour FROM cells", **_MATRIX),
)
def weekly_roster_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.matrix_highlights(rollups.weekday_hour_matrix(staffing.plan(spark, sf_dir), []))


for _grain in ("day", "week", "month"):

    @catalog.query(
        f"outlook_by_{_grain}",
        cte("compared")
        + f"SELECT {d(f'date_trunc({chr(39)}{_grain}{chr(39)}, ts)', 'period')}, {r('sum(yhat)', 'forecast')}, {r('sum(y)', 'actual')}, "
        f"{r('sum(yhat)*5.0::DOUBLE/100', 'adjustment')}, {r('sum(yhat)+sum(yhat)*5.0::DOUBLE/100', 'final')} FROM compared WHERE task IN ('calls','emails') GROUP BY date_trunc('{_grain}', ts)",
    )
    def outlook(spark: SparkSession, sf_dir: str, grain: str = _grain) -> DataFrame:
        """Forecast, actual and adjusted forecast per period, calls and e-mails."""
        return rollups.outlook(base.compared(spark, sf_dir), grain, ["calls", "emails"], adjustment_pct=5.0)


def outlook_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day as actuals, 95 % of them as forecast, 8 % of that as adjustment."""
    n = F.col("n")
    return base.daily_orders(spark, sf_dir).select(
        "date", (n * 0.95).alias("forecast"), n.alias("actual"), (n * 0.95 * 0.08).alias("adjustment")
    )


OUTLOOK_DAYS = "SELECT date, n*0.95::DOUBLE AS forecast, n AS actual, n*0.95::DOUBLE*0.08::DOUBLE AS adjustment FROM daily"


@catalog.query(
    "monthly_comparison",
    cte("daily", od=OUTLOOK_DAYS, m="SELECT date_trunc('month', date) AS month, sum(forecast) f, sum(actual) a, sum(adjustment) j FROM od GROUP BY 1")
    + f"SELECT {d('month', 'month')}, {r('f', 'forecast')}, {r('a', 'actual')}, {r('j', 'adjustment')}, {r('f+j', 'final')} FROM m ORDER BY m.month DESC LIMIT 6",
)
def monthly_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six months of forecast, actual and adjustment."""
    return rollups.monthly_comparison(outlook_days(spark, sf_dir))


@catalog.query(
    "dataset_summary",
    cte("wide") + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) AS rows, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')}, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, "
        f"{r(f'sum({c})', 'sum')}, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')} FROM wide" for c in (*VOLUME_COLUMNS, "outbound_total")
    ),
)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.dataset_summary(base.wide(spark, sf_dir))


_PROFILE = {"o_orderkey": ("bigint", True), "o_custkey": ("bigint", True), "o_orderstatus": ("string", False), "o_totalprice": ("double", True),
            "o_orderdate": ("timestamp_ntz", False), "o_orderpriority": ("string", False)}


@catalog.query(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, '{ty}' AS type, count({c}) AS known, {r(f'count({c})*100.0::DOUBLE/count(*)', 'known_pct')}, count(*)-count({c}) AS missing, "
        f"count(DISTINCT {c}) AS distinct, " + ", ".join(r(f"{fn}({c})" if num else "NULL", n) for n, fn in (("min", "min"), ("max", "max"), ("mean", "avg")))
        + " FROM orders" for c, (ty, num) in _PROFILE.items()
    ),
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.column_profile(base.table(spark, sf_dir, "orders"))


@catalog.query(
    "column_examples",
    " UNION ALL ".join(f"SELECT '{c}' AS column, least(3, count({c})) AS examples, least(3, count({c})) AS occurring FROM orders" for c in _PROFILE),
)
def column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many examples the profile shows of each column, and how many of them occur in it."""
    o = base.table(spark, sf_dir, "orders")
    shown = persist_to_shared(rollups.column_examples(o, 3), "examples")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("example")) for c in o.columns])
    # Three rows a column are broadcast; what they meet is made distinct before it leaves its task.
    met = o.select(F.explode(cells).alias("c")).select("c.*").join(F.broadcast(shown.distinct()), ["column", "example"]).distinct()
    return shown.join(met.withColumn("_met", F.lit(1)), ["column", "example"], "left").groupBy("column").agg(
        F.count(F.lit(1)).alias("examples"), F.count("_met").alias("occurring")
    )


@catalog.query(
    "quality_tiles",
    "WITH o AS (SELECT * REPLACE (CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS o_orderpriority) FROM orders), "
    "x AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE o_orderkey % 5 = 0) "
    f"SELECT count(*) AS rows, {i('sum((o_orderpriority IS NULL)::INT)', 'missing_cells')}, date_diff('day', min(o_orderdate), max(o_orderdate)) AS span_days, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM x)) AS duplicate_rows, "
    f"{r('(count(*)*6 - sum((o_orderpriority IS NULL)::INT))*100.0::DOUBLE/(count(*)*6)', 'completeness_pct')} FROM x",
)
def quality_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the orders, a fifth of which occur twice."""
    priority = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority"))
    o = base.table(spark, sf_dir, "orders").withColumn("o_orderpriority", priority)
    return rollups.quality_tiles(o.unionByName(o.filter("o_orderkey % 5 = 0")), "o_orderdate")


@catalog.query(
    "average_per_day",
    cte("wide", x="SELECT *, floor(date_diff('second', min(ts) OVER (), max(ts) OVER ())/86400)::DOUBLE AS nd FROM wide")
    + f"SELECT {r('sum(call_volume)/max(nd)', 'call_volume_per_day')}, {r('sum(email_count)/max(nd)', 'email_count_per_day')}, {i('max(nd)', 'days')} FROM x",
)
def average_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.average_per_day(base.wide(spark, sf_dir), ["call_volume", "email_count"])


@catalog.query(
    "newest_days",
    cte("daily") + f"SELECT {d()}, {r('n', 'n')} FROM daily ORDER BY daily.date DESC LIMIT 10",
)
def newest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first with a limit: a top-k, not a total sort."""
    return base.daily_orders(spark, sf_dir).select("date", "n").orderBy(F.desc("date")).limit(10)


@catalog.query(
    "task_display_names",
    cte("raw", x="SELECT DISTINCT task FROM raw UNION ALL SELECT DISTINCT 'back_' || lower(replace(event_type, 'sign', 'sign_')) FROM events")
    + "SELECT task, CASE task WHEN 'calls' THEN 'Anrufe' WHEN 'emails' THEN 'E-Mails' WHEN 'outbound_ook' THEN 'Outbound OOK' WHEN 'outbound_omk' THEN 'Outbound OMK' "
    "WHEN 'outbound_nb' THEN 'Outbound NB' WHEN 'back_click' THEN 'Back Click' WHEN 'back_view' THEN 'Back View' WHEN 'back_sign_up' THEN 'Back Sign Up' "
    "WHEN 'back_purchase' THEN 'Back Purchase' WHEN 'back_error' THEN 'Back Error' END AS label FROM x",
)
def task_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known tasks by their display name, unknown ones by their words."""
    known = base.records(spark, sf_dir).select("task")
    other = base.table(spark, sf_dir, "events").select(
        F.concat(F.lit("back_"), F.lower(F.regexp_replace("event_type", "sign", "sign_"))).alias("task")
    )
    return known.union(other).distinct().select("task", display_name(F.col("task")).alias("label"))


# --- leads ------------------------------------------------------------------


def lead_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month as leads."""
    return base.table(spark, sf_dir, "orders").groupBy(clock.month_start("o_orderdate").alias("date")).agg(
        F.count(F.lit(1)).alias("leads")
    )


_LEADS = {
    "lh": "SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*) AS leads FROM orders GROUP BY 1",
    "g": "SELECT *, (leads::DOUBLE/lag(leads) OVER (ORDER BY date) - 1)*100 AS growth, row_number() OVER (ORDER BY date) AS n FROM lh",
}


@catalog.query(
    "lead_growth",
    cte(**_LEADS)
    + f"SELECT count(*) AS n, {r('avg(growth)', 'avg_growth')}, {r('avg(growth) FILTER (n > (SELECT max(n) - 3 FROM g))', 'recent_growth')}, {r('avg(leads)', 'avg_leads')}, "
    f"{i('sum(leads)', 'total_leads')}, {r('(arg_max(leads, date)::DOUBLE/arg_min(leads, date) - 1)*100', 'total_growth')}, "
    "CASE WHEN avg(growth) FILTER (n > (SELECT max(n) - 3 FROM g)) > 0 THEN 'rising' WHEN avg(growth) FILTER (n > (SELECT max(n) - 3 FROM g)) < 0 THEN 'falling' ELSE 'stable' END AS trend FROM g",
)
def lead_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.growth(lead_history(spark, sf_dir))


@catalog.query(
    "lead_trend_line",
    cte(**_LEADS, line="SELECT regr_slope(leads, n-1) AS s, regr_intercept(leads, n-1) AS c FROM g")
    + f"SELECT {d()}, leads, {r('s', 'slope')}, {r('c', 'intercept')}, {r('c + s*(n-1)', 'trend')} FROM g, line",
)
def lead_trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.trend_line(lead_history(spark, sf_dir))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = lead_history(spark, sf_dir).withColumnRenamed("date", "month")
    return leads.adjusted(
        months.withColumn("growth_pct", (F.month("month") - 6) * F.lit(1.5))
        .withColumn("contact_rate", F.greatest(F.lit(0.0), (F.month("month") - 3) * F.lit(4.0)))
    )


_MONTHLY = "SELECT date AS month, leads, (month(date)-6)*1.5::DOUBLE AS gp, greatest(0, (month(date)-3)*4.0::DOUBLE) AS cr, round_even(leads*(1+(month(date)-6)*1.5::DOUBLE/100), 0)::BIGINT AS adj FROM lh"


@catalog.query(
    "business_metrics",
    cte(lh=_LEADS["lh"], mm=_MONTHLY)
    + f"SELECT {i('year(mm.month)', 'year')}, {i('sum(leads)', 'total_leads')}, {i('sum(adj)', 'total_adjusted')}, {r('coalesce(avg(cr) FILTER (cr > 0), 0)', 'avg_contact_rate')} FROM mm GROUP BY year(mm.month)",
)
def business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.yearly_metrics(_monthly(spark, sf_dir))


@catalog.query(
    "growth_applied_to_months",
    cte(**_LEADS, mean="SELECT round_even(avg(growth), 1) AS gp FROM g")
    + f"SELECT {d('date', 'month')}, leads, {r('gp', 'growth_pct')}, {i('round_even(leads*(1+gp/100), 0)', 'adjusted_leads')}, {i('round_even(leads*(1+gp/100), 0)-leads', 'difference')} FROM lh, mean",
)
def growth_applied_to_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = lead_history(spark, sf_dir).withColumnRenamed("date", "month")
    return leads.adjusted(leads.apply_mean_growth(months))


# --- roster -----------------------------------------------------------------


def roster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as agents, nations as centres."""
    return base.table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("centre"),
        F.concat(F.lit("Centre "), F.col("s_nationkey")).alias("centre_name"),
        (F.lit(20.0) + F.col("s_nationkey") % 5).alias("cost"),
        F.col("s_suppkey").cast("string").alias("agent"),
        F.col("s_name").alias("agent_name"),
        (F.lit(0.5) + F.lit(0.1) * (F.col("s_suppkey") % 6)).alias("fte"),
        (F.col("s_suppkey") % 7 != 0).alias("active"),
    )


_ROSTER = "SELECT s_nationkey::VARCHAR AS centre, 20.0::DOUBLE + s_nationkey % 5 AS cost, s_suppkey AS agent, 0.5::DOUBLE + 0.1::DOUBLE*(s_suppkey%6) AS fte, s_suppkey%7<>0 AS active FROM supplier"


@catalog.query(
    "roster_totals",
    cte(ro=_ROSTER) + f"SELECT count(DISTINCT centre) AS centres, count(*) AS agents, count(*) FILTER (active) AS active_agents, {r('sum(fte) FILTER (active)', 'active_fte')} FROM ro",
)
def roster_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.totals(roster_rows(spark, sf_dir))


_FTE = "coalesce(sum(fte) FILTER (active), 0)"


@catalog.query(
    "roster_cost",
    cte(ro=_ROSTER) + f"SELECT centre, {r('cost', 'cost')}, count(*) AS agents, count(*) FILTER (active) AS active_agents, {r(_FTE, 'active_fte')}, "
    f"{r(_FTE + '*cost', 'hourly_cost')}, {r(_FTE + '*cost*8', 'daily_cost')}, {r(_FTE + '*cost*8*22', 'monthly_cost')} FROM ro GROUP BY centre, cost",
)
def roster_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.by_centre(roster_rows(spark, sf_dir))
