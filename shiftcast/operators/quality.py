"""Confidence score, traffic light, explanations and peak detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, ratio
from . import metrics

DEFAULT_SCORE = 50.0


def level(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


# Signal colour of each level.
COLOURS = {"high": "#10b981", "medium": "#f59e0b", "low": "#ef4444"}


def confidence(
    training: DataFrame, keys: list[str], data_quality: float = 100.0, horizon_days: int = 7
) -> DataFrame:
    """Score from the training metrics ``(mape, r2)`` of the targets of each key."""
    mape = F.coalesce(F.col("mape"), F.lit(20.0))
    r2 = F.coalesce(F.col("r2"), F.lit(0.5))
    scored = training.groupBy(*keys).agg(
        F.avg(F.greatest(F.lit(0.0), 100 - mape * 2)).alias("_mape_score"),
        F.avg(clamp(r2 * 100, 0.0, 100.0)).alias("_r2_score"),
        F.avg(F.coalesce(F.col("mape"), F.lit(0.0))).alias("avg_mape"),
    )
    penalty = min(20.0, horizon_days * 0.5)
    raw = F.col("_mape_score") * 0.5 + F.col("_r2_score") * 0.3 + F.lit(data_quality * 0.2) - penalty
    score = F.coalesce(F.bround(clamp(raw, 0.0, 100.0), 1), F.lit(DEFAULT_SCORE))
    score = F.when(F.col("_mape_score").isNull(), F.lit(DEFAULT_SCORE)).otherwise(score)
    return scored.withColumn("score", score).drop("_mape_score", "_r2_score")


def indicator(
    training: DataFrame, keys: list[str], data_quality: float = 100.0, horizon_days: int = 7
) -> DataFrame:
    """Score, level, colour and the codes of the explanations that apply."""
    scored = confidence(training, keys, data_quality, horizon_days).withColumn("level", level(F.col("score")))
    colour = F.create_map(*[F.lit(v) for kv in COLOURS.items() for v in kv])
    lv, m = F.col("level"), F.col("avg_mape")
    codes = F.array_compact(
        F.array(
            F.when(lv == "high", "PATTERNS_CAPTURED"),
            F.when(lv == "high", "PAST_PREDICTIONS_ACCURATE"),
            F.when(lv == "medium", "PLAN_BUFFER_10_15_PCT"),
            F.when(lv == "medium", "PATTERNS_VARIABLE"),
            F.when(lv == "low", "LIMITED_HISTORY"),
            F.when(lv == "low", "MANUAL_REVIEW"),
            F.when(F.lit(horizon_days > 14), "LONG_HORIZON"),
            F.when(m < 10, "ERROR_WITHIN_10_PCT").when(m < 20, "ERROR_WITHIN_20_PCT")
            .when(m.isNotNull(), "ERROR_ABOVE_20_PCT"),
        )
    )
    return scored.withColumn("colour", colour[F.col("level")]).withColumn("codes", codes)


def comparison_verdict(accuracy: Column) -> Column:
    return (
        F.when(accuracy >= 90, "EXCELLENT").when(accuracy >= 80, "GOOD").when(accuracy >= 70, "ACCEPTABLE")
        .when(accuracy >= 60, "MODERATE").otherwise("POOR")
    )


def compare(compared: DataFrame, keys: list[str], target: str = "task") -> DataFrame:
    """Overall accuracy, verdict, and per-target notes of a forecast.

    Without a single matching row the result is one row of accuracy 0 and MAPE 100.
    """
    targets = metrics.target_quality(compared, [*keys, target])
    diff = F.col("total_actual") - F.col("total_predicted")
    noted = targets.withColumn(
        "_note",
        F.when(F.col("accuracy") >= 90, F.concat(target, F.lit(":ACCURATE")))
        .when((F.col("accuracy") < 70) & (diff > 0), F.concat(target, F.lit(":UNDER_FORECAST")))
        .when(F.col("accuracy") < 70, F.concat(target, F.lit(":OVER_FORECAST"))),
    )
    overall = noted.groupBy(*keys).agg(
        F.avg("raw_mape").alias("_mape"),
        F.avg(F.greatest(F.lit(0.0), 100 - F.col("raw_mape"))).alias("_accuracy"),
        F.count(F.lit(1)).alias("targets"),
        F.array_sort(F.collect_list("_note")).alias("notes"),  # one per target
    )
    if not keys:
        one = compared.sparkSession.range(1).select(F.lit(1).alias("_one"))
        overall = one.join(overall.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return (
        overall.withColumn("overall_mape", F.bround(F.coalesce("_mape", F.lit(100.0)), 1))
        .withColumn("overall_accuracy", F.bround(F.coalesce("_accuracy", F.lit(0.0)), 1))
        .withColumn("verdict", comparison_verdict(F.coalesce("_accuracy", F.lit(0.0))))
        .drop("_mape", "_accuracy")
    )


def peak_detection(compared: DataFrame, keys: list[str], percentile: float = 75.0) -> DataFrame:
    """Recall of actual peaks and share of predicted peaks that were none.

    Thresholds are taken per side over one series' hours; the threshold table
    has one row per series.
    """
    limits = compared.groupBy(*keys).agg(
        F.percentile("yhat", percentile / 100).alias("_pt"), F.percentile("y", percentile / 100).alias("_at")
    )
    joined = compared.join(limits, keys) if keys else compared.crossJoin(F.broadcast(limits))
    p, a = F.col("yhat") >= F.col("_pt"), F.col("y") >= F.col("_at")
    counts = joined.groupBy(*keys).agg(
        F.count_if(p & a).alias("peaks_detected"),
        F.count_if(~p & a).alias("peaks_missed"),
        F.count_if(p & ~a).alias("false_alarms"),
    )

    def share(part: str, other: str) -> Column:
        whole = F.col("peaks_detected") + F.col(other)
        rate = ratio(F.col(part).cast("double"), whole.cast("double")) * 100
        return F.bround(F.coalesce(rate, F.lit(0.0)), 1)

    return counts.withColumn("detection_rate", share("peaks_detected", "peaks_missed")).withColumn(
        "false_positive_rate", share("false_alarms", "false_alarms")
    )
