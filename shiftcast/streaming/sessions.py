"""Activity sessions and audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock

GAP_MINUTES = 60


def sessions(events: DataFrame, user: str = "user", ts: str = "ts", gap_minutes: int = GAP_MINUTES) -> DataFrame:
    """Sessions ended by more than ``gap_minutes`` without activity: ``(user, start, end, events)``.

    Events of one minute always belong together, so they are first counted per
    user and minute with a map-side combine. What is ordered afterwards is at
    most one row per user and minute of the span, however many events a user has.
    """
    if gap_minutes < 1:
        raise ValueError("the gap must be at least one minute")
    gap = gap_minutes * 60 * 1_000_000
    at = clock.epoch_micros(ts)
    rows = events.select(F.col(user).alias("user"), F.col(ts).alias("ts"), at.alias("_at"), F.floor(at / 60_000_000).alias("_minute"))
    minutes = rows.groupBy("user", "_minute").agg(
        F.min("ts").alias("_s"), F.max("ts").alias("_e"), F.min("_at").alias("_sa"), F.max("_at").alias("_ea"), F.count(F.lit(1)).alias("_n")
    )
    ordered = Window.partitionBy("user").orderBy("_minute")
    apart = (F.col("_sa") - F.lag("_ea").over(ordered)) > gap
    numbered = minutes.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    numbered = numbered.withColumn("_session", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("user", "_session")
        .agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.sum("_n").alias("events"))
        .drop("_session")
    )


def live_sessions(
    stream: DataFrame, user: str = "user", ts: str = "ts", gap_minutes: int = GAP_MINUTES, lateness: str = "2 hours"
) -> DataFrame:
    """Sessions on a stream, ended like those of ``sessions`` by a longer gap only.

    ``end`` is the last activity: the session window's end less the gap.
    """
    gap = f"{gap_minutes} minutes"
    return (
        stream.select(F.col(user).alias("user"), clock.as_instant(ts).alias("_at"))
        .withWatermark("_at", lateness)
        .groupBy(F.session_window("_at", gap).alias("_w"), "user")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            "user", clock.from_instant("_w.start").alias("start"),
            (clock.from_instant("_w.end") - F.expr(f"INTERVAL {gap_minutes} MINUTE")).alias("end"), "events",
        )
    )


AUDIT = (
    "timestamp string, level string, logger string, message string, module string, function string, line int, "
    "user string, action string, details map<string,string>"
)


def log_line(df: DataFrame) -> DataFrame:
    """JSON log lines from ``(timestamp, level, user, action, details)``."""
    return df.select(
        F.to_json(
            F.struct(
                F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp"),
                "level", F.lit("audit").alias("logger"), "user", "action", "details",
            )
        ).alias("value")
    )


def audit_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed log lines; lines that are no JSON record are dropped. Batch or stream."""
    stamp = F.regexp_replace("r.timestamp", "Z$", "").try_cast("timestamp_ntz")
    outcome = (
        F.when(F.col("r.level") == "INFO", "success").when(F.col("r.level") == "WARNING", "failure").otherwise("other")
    )
    return (
        lines.select(F.from_json(column, AUDIT).alias("r"))
        .filter(F.col("r.action").isNotNull())
        .select("r.user", "r.action", outcome.alias("outcome"), stamp.alias("ts"), "r.details")
    )


def audit_counts(records: DataFrame) -> DataFrame:
    """Actions by user, action and outcome. Batch, or a stream in update or complete mode."""
    return records.groupBy("user", "action", "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
