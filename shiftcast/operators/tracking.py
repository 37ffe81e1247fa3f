"""Forecast store, actuals store and forecast-against-actual comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import day_name
from ..functions.numbers import ratio
from ..session import persist_to_shared
from . import metrics

POINT_COLUMNS = ["forecast_id", "created_at", "model_version", "task", "ts", "yhat"]


# --- stores -------------------------------------------------------------------


def to_points(wide: DataFrame, forecast_id: str, created_at: str, model_version: str) -> DataFrame:
    """Wide forecast (``ts`` and one column per target) to the long store layout."""
    targets = [c for c in wide.columns if c not in ("ts", "timestamp", "date")]
    entries = ", ".join(f"'{c}', cast(`{c}` as double)" for c in targets)
    return wide.select(
        F.lit(forecast_id).alias("forecast_id"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.lit(model_version).alias("model_version"),
        F.expr(f"stack({len(targets)}, {entries}) as (task, yhat)"),
        "ts",
    ).select(*POINT_COLUMNS)


def save_points(points: DataFrame, path: str) -> None:
    """Appends to a store with a directory per forecast, each in ranges of task and time, so
    that a lookup reads one directory and a span of it few row groups."""
    order = ["forecast_id", "task", "ts"]
    ranged = points.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("append").partitionBy("forecast_id").parquet(path)


def load_points(spark: SparkSession, path: str, forecast_id: str | None = None) -> DataFrame:
    points = spark.read.parquet(path).select(*POINT_COLUMNS)
    return points if forecast_id is None else points.filter(F.col("forecast_id") == forecast_id)


def delete_forecast(points: DataFrame, forecast_id: str) -> DataFrame:
    """The store without one forecast, to be written to a new path."""
    return points.filter(F.col("forecast_id") != forecast_id)


def headers(points: DataFrame) -> DataFrame:
    """One row per forecast with its span."""
    return points.groupBy("forecast_id", "created_at", "model_version").agg(
        F.min("ts").alias("forecast_start"), F.max("ts").alias("forecast_end")
    )


def list_forecasts(
    points: DataFrame, limit: int | None = None, start: Column | None = None, end: Column | None = None
) -> DataFrame:
    """Headers, newest first."""
    out = headers(points)
    if start is not None:
        out = out.filter(F.col("forecast_start") >= start)
    if end is not None:
        out = out.filter(F.col("forecast_end") <= end)
    out = out.orderBy(F.desc("created_at"), F.desc("forecast_id"))
    return out.limit(limit) if limit else out


def points_from_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Nested records (a map of value arrays beside one array of times) to points."""
    record = (
        "struct<forecast_id:string,created_at:timestamp_ntz,model_version:string,forecast_start:timestamp_ntz,"
        "forecast_end:timestamp_ntz,predictions:map<string,array<double>>,timestamps:array<timestamp_ntz>,"
        "created_by:string,notes:string>"
    )
    r = documents.select(F.explode(F.from_json(column, f"map<string,{record}>")).alias("_id", "r"))
    per_task = r.select("r.*", F.explode("r.predictions").alias("task", "_values"))
    zipped = F.explode(F.arrays_zip(F.col("timestamps").alias("ts"), F.col("_values").alias("yhat")))
    return per_task.withColumn("_z", zipped).select(
        "forecast_id", "created_at", "model_version", "task", F.col("_z.ts").alias("ts"), F.col("_z.yhat").alias("yhat")
    ).filter("yhat IS NOT NULL")


def points_to_json(points: DataFrame) -> DataFrame:
    """One ``(forecast_id, json)`` record per forecast. A record holds one
    forecast's horizon, which its length in hours bounds.

    The times are those of all tasks together; where a task has none of them its
    value is NULL, so that tasks with other horizons keep their times.
    """
    record = points.groupBy("forecast_id", "created_at", "model_version").agg(
        F.array_sort(F.collect_set("ts")).alias("timestamps"),
        F.collect_set("task").alias("_tasks"),
        F.map_from_entries(F.collect_list(F.struct(F.struct("task", "ts"), "yhat"))).alias("_at"),
    )
    values = F.transform(
        "_tasks",
        lambda task: F.struct(
            task.alias("task"),
            F.transform(
                "timestamps",
                lambda ts: F.try_element_at("_at", F.struct(task.alias("task"), ts.alias("ts"))),
            ).alias("values"),
        ),
    )
    body = F.struct(
        "forecast_id", "created_at", "model_version",
        F.array_min("timestamps").alias("forecast_start"), F.array_max("timestamps").alias("forecast_end"),
        F.map_from_entries(values).alias("predictions"), "timestamps",
    )
    return record.select("forecast_id", F.to_json(F.create_map("forecast_id", body)).alias("json"))


def upsert(
    existing: DataFrame, new: DataFrame, keys: list[str], values: list[str], prefer: str = "existing"
) -> DataFrame:
    """Full outer merge on keys; on conflict the known value of the preferred side stays."""
    if prefer not in ("existing", "new"):
        raise ValueError(f"unknown side {prefer!r}")
    first, second = (existing, new) if prefer == "existing" else (new, existing)
    joined = first.alias("a").join(second.alias("b"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"a.{v}"), F.col(f"b.{v}")).alias(v) for v in values])


def merge(existing: DataFrame, new: DataFrame, keys: list[str], values: list[str], strategy: str) -> DataFrame:
    """``append`` keeps all rows, ``replace`` only the new, ``merge_by_timestamp`` merges by key."""
    if strategy == "append":
        return existing.unionByName(new, allowMissingColumns=True)
    if strategy == "replace":
        return new
    if strategy == "merge_by_timestamp":
        return upsert(existing, new, keys, values, prefer="new")
    raise ValueError(f"unknown strategy {strategy!r}")


# --- comparison ---------------------------------------------------------------


def compare(points: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of predictions and actuals on keys and hour."""
    return points.join(actuals.withColumnRenamed("volume", "y"), [*keys, "ts"])


def accuracy_summary(points: DataFrame, actuals: DataFrame, keys: list[str], limit: int = 10) -> DataFrame:
    """Metrics of the newest forecasts, all of them in one join and one aggregation."""
    newest = list_forecasts(points, limit)  # at most ``limit`` rows
    recent = points.join(F.broadcast(newest.select("forecast_id", "forecast_start", "forecast_end")), "forecast_id")
    return metrics.accuracy(
        compare(recent, actuals, keys),
        ["forecast_id", "created_at", "model_version", "forecast_start", "forecast_end", *keys],
    ).select(
        "forecast_id", "created_at", "model_version", *keys, "mae", "mape", "rmse", "accuracy_pct",
        "forecast_start", "forecast_end",
    )


def mape_by(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """MAPE per hour of the day or per weekday name; 0 where every actual is zero."""
    label = {"hour": F.hour("ts"), "weekday": day_name("ts")}[part]
    share = metrics.mape(F.col("yhat"), F.col("y"))
    return metrics.pairs(df).groupBy(*keys, label.alias(part)).agg(F.coalesce(share, F.lit(0.0)).alias("mape"))


def nested_breakdown(df: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The same as one map per key, at most 24 entries."""
    entry = F.struct(F.col(part), F.col("mape"))
    return mape_by(df, keys, part).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{part}_mape")
    )


# --- feedback -----------------------------------------------------------------

FEEDBACK = (
    "forecast_id string, timestamp timestamp_ntz, accuracy_metrics map<string,map<string,double>>, "
    "feedback_note string, user string"
)


def save_feedback(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def historical_accuracy(feedback: DataFrame, limit: int = 50) -> DataFrame:
    """Mean MAPE and accuracy, best and worst over the latest entries."""
    latest = feedback.orderBy(F.desc("timestamp"), F.desc("forecast_id")).limit(limit)
    flat = latest.select("forecast_id", "timestamp", F.explode_outer("accuracy_metrics").alias("target", "m"))
    value = {k: F.try_element_at("m", F.lit(k)) for k in ("mape", "accuracy")}
    return flat.agg(
        F.avg(value["mape"]).alias("avg_mape"),
        F.avg(value["accuracy"]).alias("avg_accuracy"),
        F.count_distinct(F.struct("forecast_id", "timestamp")).alias("n_forecasts_evaluated"),
        F.max(value["accuracy"]).alias("best_accuracy"),
        F.min(value["accuracy"]).alias("worst_accuracy"),
    )


def learning_insights(summary: DataFrame, keys: list[str], window: int = 5) -> DataFrame:
    """Mean error, trend of the newest against the oldest rows, number of targets above 20 %.

    Both ends are top-k selections, not a ranking of all rows. The summary is
    read four times, so it is written once to the shared folder first.
    """
    summary = persist_to_shared(summary.select(*keys, "created_at", "forecast_id", "mape"), "summary")
    newest = [F.desc("created_at"), F.desc("forecast_id"), *[F.asc(k) for k in keys]]
    oldest = [F.asc("created_at"), F.asc("forecast_id"), *[F.desc(k) for k in keys]]

    def end(order: list[Column], name: str) -> DataFrame:
        return summary.orderBy(*order).limit(window).agg(F.avg("mape").alias(name))

    overall = (
        summary.agg(F.count(F.lit(1)).alias("rows"), F.avg("mape").alias("avg_mape"))
        .crossJoin(F.broadcast(end(newest, "recent_mape")))
        .crossJoin(F.broadcast(end(oldest, "older_mape")))
    )
    trend = (
        F.when(F.col("rows") < window, F.lit(None))
        .when(F.col("recent_mape") < F.col("older_mape"), "improving")
        .when(F.col("recent_mape") > F.col("older_mape") * 1.1, "declining")
    )
    listed = high_error_targets(summary, keys).agg(F.count(F.lit(1)).alias("high_error_targets"))
    return (
        overall.withColumn("avg_accuracy", 100 - F.col("avg_mape"))
        .withColumn("trend", trend)
        .withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("insufficient_data"))
        .crossJoin(F.broadcast(listed))
    )


def high_error_targets(summary: DataFrame, keys: list[str], above: float = 20.0) -> DataFrame:
    """One row per target whose mean error lies above so many percent."""
    return error_by_target(summary, keys).filter(F.col("mape") > above)


def error_by_target(summary: DataFrame, keys: list[str]) -> DataFrame:
    return summary.groupBy(*keys).agg(F.avg("mape").alias("mape"))


# --- outlook ------------------------------------------------------------------


def outlook_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy of forecast and adjusted forecast on the totals, and mean error per row."""
    final = F.col("forecast") + F.col("adjustment")
    totals = df.agg(
        F.sum("forecast").alias("_f"), F.sum("actual").alias("_a"), F.sum(final).alias("_z"),
        metrics.mape(F.col("forecast"), F.col("actual"), "zero_is_0").alias("mape"),
        F.count_if(F.col("forecast") > F.col("actual")).alias("over_forecast"),
        F.count_if(F.col("forecast") < F.col("actual")).alias("under_forecast"),
    )

    def share(c: str) -> Column:
        reached = F.greatest(F.lit(0.0), 100 - ratio(F.abs(F.col(c) - F.col("_a")), F.col("_a")) * 100)
        return F.when(F.col("_a") > 0, reached).otherwise(F.lit(0.0))

    return totals.select(
        share("_f").alias("forecast_accuracy"), share("_z").alias("final_accuracy"),
        (share("_z") - share("_f")).alias("improvement"), "mape", "over_forecast", "under_forecast",
    )


def error_bands(df: DataFrame) -> DataFrame:
    """Error in percent of the actual (a zero actual counts as 1) and its band."""
    base = F.when(F.col("actual") == 0, F.lit(1.0)).otherwise(F.col("actual"))
    pct = ratio(F.col("forecast") - F.col("actual"), base) * 100
    band = F.when(F.col("error_pct") > 10, "high").when(F.col("error_pct") > 0, "moderate").otherwise("low")
    return df.withColumn("error_pct", pct).withColumn("band", band)
