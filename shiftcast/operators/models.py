"""Model metadata: an append-only table of versions and activations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT = (
    "model_id string, version string, event string, at timestamp_ntz, model_type string, created_by string, "
    "data_hash string, samples bigint, first_ts timestamp_ntz, last_ts timestamp_ntz, "
    "metrics map<string,map<string,double>>"
)


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and a 12-digit digest that depends on every row and not on their order.

    Sums of both halves of a row's MD5, 60 bits each and kept as decimals so that they cannot
    overflow. A row is its values as text, each after its length, so that any engine can
    compute the digest; a null is ``-``.
    """
    names = F.lit(",".join(df.columns))
    text = [F.col(f"`{c}`").cast("string") for c in df.columns]
    row = F.md5(F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("-")) for c in text]))
    one, two = (F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 17))
    return df.agg(F.count(F.lit(1)).alias("rows"), one.alias("_a"), two.alias("_b")).select(
        "rows", F.substring(F.md5(F.concat_ws("|", F.col("rows"), names, F.col("_a"), F.col("_b"))), 1, 12).alias("data_hash")
    )


def registration(
    training: DataFrame, model_id: str, version: str, at: str, model_type: str = "", created_by: str = "",
    metrics: Column | None = None, ts: str = "ts",
) -> DataFrame:
    """The event row that registers and activates a version trained on ``training``."""
    span = training.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    empty = F.lit(None).cast("map<string,map<string,double>>")
    return fingerprint(training).crossJoin(span).select(
        F.lit(model_id).alias("model_id"), F.lit(version).alias("version"), F.lit("register").alias("event"),
        F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(model_type).alias("model_type"),
        F.lit(created_by).alias("created_by"), "data_hash", F.col("rows").alias("samples"), "first_ts", "last_ts",
        (metrics if metrics is not None else empty).alias("metrics"),
    )


def event(log: DataFrame, model_id: str, version: str, kind: str, at: str) -> DataFrame:
    """An ``activate`` or ``delete`` row; deleting the active version is refused."""
    if kind not in ("activate", "delete"):
        raise ValueError(f"unknown event {kind!r}")
    known = versions(log).filter((F.col("model_id") == model_id) & (F.col("version") == version))
    state = known.select("is_active").head()
    if state is None:
        raise LookupError(f"no version {version} of {model_id}")
    if kind == "delete" and state["is_active"]:
        raise ValueError("the active version cannot be deleted")
    row = (model_id, version, kind, None, None, None, None, None, None, None, None)
    made = log.sparkSession.createDataFrame([row], EVENT)
    return made.withColumn("at", F.lit(at).cast("timestamp_ntz"))


def versions(log: DataFrame) -> DataFrame:
    """Current versions with an active flag, derived from the latest activation."""
    chosen = F.col("event").isin("register", "activate")
    active = log.filter(chosen).groupBy("model_id").agg(F.max_by("version", "at").alias("_active"))
    gone = log.filter("event = 'delete'").select("model_id", "version").distinct()
    kept = log.filter("event = 'register'").drop("event").join(gone, ["model_id", "version"], "left_anti")
    return (
        kept.join(active, "model_id")
        .withColumn("is_active", F.col("version") == F.col("_active"))
        .withColumnRenamed("at", "created_at")
        .drop("_active")
    )


def current(log: DataFrame) -> DataFrame:
    """The active version of each model, else its latest."""
    v = versions(log)
    best = F.max_by(F.struct(*[c for c in v.columns if c != "model_id"]), F.struct("is_active", "created_at"))
    return v.groupBy("model_id").agg(best.alias("_v")).select("model_id", "_v.*")


def summary(log: DataFrame) -> DataFrame:
    """Versions, active version, first and last date and latest metrics per model."""
    active = F.col("is_active")
    return versions(log).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("total_versions"),
        F.max(F.when(active, F.col("version"))).alias("active_version"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_updated"),
        F.max_by("model_type", F.when(active, F.col("created_at"))).alias("model_type"),
        F.max_by("metrics", F.when(active, F.col("created_at"))).alias("latest_metrics"),
    )


def log_of(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


# The nested registry document: model id -> its versions in order of creation.
VERSION = (
    "struct<model_id:string,version:string,model_type:string,created_at:timestamp_ntz,created_by:string,"
    "training_data_hash:string,training_samples:bigint,training_date_range:array<timestamp_ntz>,"
    "features_used:array<string>,target_columns:array<string>,metrics:map<string,map<string,double>>,"
    "is_active:boolean,description:string>"
)


def from_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Registry documents as an event log; the version marked active is activated last."""
    v = documents.select(F.explode(F.from_json(column, f"map<string,array<{VERSION}>>")).alias("model_id", "_v"))
    v = v.select("model_id", F.explode("_v").alias("v"))
    body = [
        F.col("v.model_type").alias("model_type"), F.col("v.created_by").alias("created_by"),
        F.col("v.training_data_hash").alias("data_hash"), F.col("v.training_samples").alias("samples"),
        F.get("v.training_date_range", F.lit(0)).alias("first_ts"), F.get("v.training_date_range", F.lit(1)).alias("last_ts"),
        F.col("v.metrics").alias("metrics"),
    ]
    head = ["model_id", F.col("v.version").alias("version")]
    made = v.select(*head, F.lit("register").alias("event"), F.col("v.created_at").alias("at"), *body)
    newest = v.groupBy("model_id").agg(F.max("v.created_at").alias("_last"))
    chosen = v.filter("v.is_active").join(newest, "model_id")
    after = F.col("_last") + F.expr("INTERVAL 1 MICROSECOND")
    return made.unionByName(chosen.select(*head, F.lit("activate").alias("event"), after.alias("at"), *body))


def metric_rows(log: DataFrame) -> DataFrame:
    """``(model_id, version, target, metric, value)`` of the current versions."""
    per_target = versions(log).select("model_id", "version", F.explode("metrics").alias("target", "_m"))
    return per_target.select("model_id", "version", "target", F.explode("_m").alias("metric", "value"))
