"""Residual analysis of forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.numbers import normal_quantile, ratio
from ..functions.special import f_survival
from .metrics import mape


def residuals(compared: DataFrame) -> DataFrame:
    """Adds residual (actual minus predicted), hour and weekday."""
    return compared.withColumns(
        {
            "residual": F.col("y") - F.col("yhat"),
            "hour": F.hour("ts"),
            "day_of_week": F.weekday("ts"),
            "day_name": clock.day_name("ts"),
        }
    )


def _errors() -> list[Column]:
    res = F.col("residual")
    return [F.avg(F.abs(res)).alias("mae"), F.sqrt(F.avg(res * res)).alias("rmse"), F.avg(res).alias("bias")]


def metrics_by(res: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Errors per group; the MAPE is NULL where no actual is positive."""
    share = F.when(F.max("y") > 0, mape(F.col("yhat"), F.col("y")))
    return res.groupBy(*keys, group).agg(*_errors(), share.alias("mape"), F.count(F.lit(1)).alias("count"))


def residual_statistics(res: DataFrame, keys: list[str]) -> DataFrame:
    return res.groupBy(*keys).agg(F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std"))


def normality(res: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Jarque–Bera statistic from skewness and kurtosis; its limit law has p = exp(-JB / 2)."""
    out = res.groupBy(*keys).agg(
        F.count("residual").alias("n"), F.skewness("residual").alias("skewness"), F.kurtosis("residual").alias("kurtosis")
    )
    jb = F.col("n") / 6.0 * (F.pow("skewness", 2) + F.pow("kurtosis", 2) / 4)
    return out.withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2)).withColumn(
        "is_normal", F.col("p_value") > alpha
    )


def spread_test(res: DataFrame, keys: list[str], min_rows: int = 10) -> DataFrame:
    """Brown–Forsythe F: spread of the residuals below and above the median prediction.

    Medians are taken over one series' hours. NULL where a half has too few rows.
    """
    middle = res.groupBy(*keys).agg(F.median("yhat").alias("_mid"))
    halves = (res.join(middle, keys) if keys else res.crossJoin(F.broadcast(middle))).withColumn(
        "_high", F.col("yhat") >= F.col("_mid")
    )
    centres = halves.groupBy(*keys, "_high").agg(F.median("residual").alias("_centre"))
    z = halves.join(centres, [*keys, "_high"]).withColumn("_z", F.abs(F.col("residual") - F.col("_centre")))
    groups = z.groupBy(*keys, "_high").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_z").alias("_m"), (F.var_pop("_z") * F.count(F.lit(1))).alias("_ss")
    )
    total = groups.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.min("_n").alias("smallest"), F.count(F.lit(1)).alias("_k"),
        F.sum(F.col("_n") * F.col("_m")).alias("_s"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_q"),
        F.sum("_ss").alias("_within"),
    )
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    f = ratio((F.col("n") - 2) * between, F.col("_within"))
    enough = (F.col("_k") == 2) & (F.col("smallest") > min_rows)
    return total.select(*keys, "n", F.when(enough, f).alias("statistic"))


def heteroscedasticity(res: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """The spread test with its p-value and verdict."""
    p = f_survival(F.col("statistic"), F.lit(1.0), (F.col("n") - 2).cast("double"))
    return spread_test(res, keys).withColumn("p_value", p).withColumn(
        "is_heteroscedastic", F.when(F.col("statistic").isNotNull(), F.col("p_value") < alpha)
    )


def worst(res: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Group with the largest MAPE; the smallest of several."""
    ranked = F.max_by(F.struct(F.col(group), F.col("mape")), F.when(F.col("mape").isNotNull(), F.struct(F.col("mape"), -F.col(group))))
    best = metrics_by(res, keys, group).groupBy(*keys).agg(ranked.alias("_w"))
    return best.select(*keys, F.col(f"_w.{group}").alias(f"worst_{group}"), F.col("_w.mape").alias(f"worst_{group}_mape"))


def summary(res: DataFrame, keys: list[str]) -> DataFrame:
    """Overall errors, normality, worst hour and worst weekday per series."""
    overall = res.groupBy(*keys).agg(*_errors(), F.stddev_samp("residual").alias("std"))
    parts = [normality(res, keys).select(*keys, "is_normal"), worst(res, keys, "hour"), worst(res, keys, "day_of_week")]
    for part in parts:
        overall = overall.join(part, keys, "left") if keys else overall.crossJoin(part)
    return overall


def qq_pairs(res: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted residuals beside normal quantiles at n evenly spaced shares of [0.01, 0.99]."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy("residual", "ts"))
    n = F.count(F.lit(1)).over(w)
    share = F.lit(0.01) + F.lit(0.98) * F.coalesce(ratio((at - 1).cast("double"), (n - 1).cast("double")), F.lit(0.0))
    return (
        res.withColumn("rank", at).withColumn("share", share)
        .withColumn("theoretical", normal_quantile(F.col("share")))
        .select(*keys, "rank", "share", "theoretical", F.col("residual").alias("sample"))
    )
