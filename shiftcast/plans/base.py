"""Shared inputs of the queries and the SQL fragments that mirror them.

The driver tables become workload: each event type stands for a task, each
event is one record, and ``user_id % 10`` is the site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import forecast, hourly

Query = Callable[[SparkSession, str], DataFrame]

SERIES = ["site", "task"]

OUTBOUND = ["outbound_ook", "outbound_omk", "outbound_nb"]

# Event type -> task.
EVENT_TASKS = {
    "click": "calls",
    "view": "emails",
    "signup": "outbound_ook",
    "purchase": "outbound_omk",
    "error": "outbound_nb",
}


class Catalog:
    """Queries by name, with their SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name!r} is registered twice")

            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return comparable(fn(spark, sf_dir))

            run.__name__ = name
            run.__doc__ = fn.__doc__
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


# Added before rounding, far below the last digit kept: a value that lies exactly
# between two roundings then falls to the same side whatever the summation order.
NUDGE = 3e-10


def comparable(df: DataFrame) -> DataFrame:
    """Widens integers, rounds doubles to six places and prints times to the
    microsecond, so that both engines' results have the same representation."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- Spark side -----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, tasks: list[str] | None = None) -> DataFrame:
    """``(site, task, ts, value)``, one row per event, or per event of some tasks: their
    types are a filter that the scan takes."""
    mapping = F.create_map(*[F.lit(v) for kv in EVENT_TASKS.items() for v in kv])
    events = table(spark, sf_dir, "events")
    if tasks is not None:
        events = events.filter(F.col("event_type").isin([e for e, t in EVENT_TASKS.items() if t in tasks]))
    return events.select(
        (F.col("user_id") % 10).alias("site"),
        mapping[F.col("event_type")].alias("task"),
        "ts",
        "value",
    )


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly ``(site, task, ts, volume)``."""
    return hourly.dense_hourly(records(spark, sf_dir), SERIES)


def workload_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly ``(task, ts, volume)`` over all sites."""
    return hourly.dense_hourly(records(spark, sf_dir), ["task"])


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense hourly table with one volume column per task, over all sites."""
    return hourly.combine(records(spark, sf_dir), [])


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(date, n, total)`` of the orders; one row per day on which there were any."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("total"))
    )


def with_origin(bounds: DataFrame) -> DataFrame:
    """One row ``(lo, hi, origin)``: the origin is midnight eight days before the last day."""
    return bounds.withColumn("origin", F.date_sub(F.to_date("hi"), 8).cast("timestamp_ntz"))


def split_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_origin(hourly.time_bounds(records(spark, sf_dir)))


def workload_with_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``workload_all`` with the origin beside every row; the records are scanned once."""
    counts = hourly.aggregate_hourly(records(spark, sf_dir), ["task"])
    bounds = with_origin(hourly.hour_bounds(counts, "volume"))
    return hourly.densify(counts, ["task"], ["volume"], bounds, carry=("origin",))


def history_and_actuals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The workload over all sites before (with its origin) and from the origin on."""
    w = workload_with_origin(spark, sf_dir)
    return w.filter("ts < origin"), w.filter("ts >= origin").drop("origin")


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task, ts, yhat, y)``: seasonal-naive forecast of the last nine days beside the actual volume."""
    return forecast.backtest_last_week(workload_with_origin(spark, sf_dir), ["task"], 9 * 24)


# --- SQL side -------------------------------------------------------------

_CASE = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in EVENT_TASKS.items())

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), f"SELECT user_id % 10 AS site, CASE event_type {_CASE} END AS task, ts, value FROM events"),
    "bounds": ((), "SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events"),
    "hourly": (("raw",), "SELECT site, task, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS volume FROM raw GROUP BY ALL"),
    "hourly_all": (("raw",), "SELECT task, date_trunc('hour', ts) AS ts, count(*)::DOUBLE AS volume FROM raw GROUP BY ALL"),
    "workload": (
        ("hourly", "bounds"),
        "SELECT s.site, s.task, s.ts, coalesce(h.volume, 0) AS volume FROM (SELECT site, task, "
        "unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT site, task FROM hourly), bounds) s "
        "LEFT JOIN hourly h USING (site, task, ts)",
    ),
    "workload_all": (
        ("hourly_all", "bounds"),
        "SELECT s.task, s.ts, coalesce(h.volume, 0) AS volume FROM (SELECT task, "
        "unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT task FROM hourly_all), bounds) s "
        "LEFT JOIN hourly_all h USING (task, ts)",
    ),
    "wide": (
        ("workload_all",),
        "SELECT *, outbound_ook + outbound_omk + outbound_nb AS outbound_total FROM (SELECT ts, "
        "coalesce(sum(volume) FILTER (task = 'calls'), 0) AS call_volume, "
        "coalesce(sum(volume) FILTER (task = 'emails'), 0) AS email_count, "
        "coalesce(sum(volume) FILTER (task = 'outbound_ook'), 0) AS outbound_ook, "
        "coalesce(sum(volume) FILTER (task = 'outbound_omk'), 0) AS outbound_omk, "
        "coalesce(sum(volume) FILTER (task = 'outbound_nb'), 0) AS outbound_nb "
        "FROM workload_all GROUP BY ts)",
    ),
    "daily": ((), "SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1"),
    "split": (("bounds",), "SELECT *, (hi::DATE - 8)::TIMESTAMP AS origin FROM bounds"),
    "compared": (
        ("workload_all", "split"),
        "SELECT a.task, a.ts, p.volume AS yhat, a.volume AS y FROM workload_all a, split, workload_all p "
        "WHERE a.ts >= origin AND p.task = a.task AND p.ts = a.ts - to_hours((168 * (1 + "
        "date_diff('hour', origin, a.ts) // 168))::INT)",
    ),
}


def cte(*names: str, **extra: str) -> str:
    """``WITH`` clause of the named fragments, their inputs first, then ``extra``."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        needs, body = CTES[name]
        for n in needs:
            visit(n)
        ordered.setdefault(name, body)

    for n in names:
        visit(n)
    ordered.update(extra)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in ordered.items()) + " "


def r(expr: str, name: str) -> str:
    """A double rounded as :func:`comparable` does."""
    return f"round(({expr})::DOUBLE + {NUDGE!r}, 6) + 0.0 AS {name}"


def i(expr: str, name: str) -> str:
    return f"({expr})::BIGINT AS {name}"


def t(expr: str = "ts", name: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def d(expr: str = "date", name: str = "date") -> str:
    return f"strftime(({expr})::DATE, '%Y-%m-%d') AS {name}"
