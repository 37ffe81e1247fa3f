"""Accuracy of predictions against actuals, in one aggregation per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct_error, ratio


def pairs(df: DataFrame, pred: str = "yhat", actual: str = "y") -> DataFrame:
    """Rows on which both sides are known numbers."""
    def known(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c))

    return df.filter(known(pred) & known(actual))


def mape(pred: Column, actual: Column, zero_policy: str = "nonzero") -> Column:
    return F.avg(pct_error(pred, actual, zero_policy)) * 100


def r_squared(pred: Column, actual: Column, policy: str = "zero") -> Column:
    """1 - residual over total variation. Constant actuals give 0 under ``zero``;
    under ``score`` a perfect prediction of them gives 1."""
    residual = F.sum((actual - pred) * (actual - pred))
    total = F.var_pop(actual) * F.count(actual)
    flat = F.lit(0.0)
    if policy == "score":
        flat = F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    elif policy != "zero":
        raise ValueError(f"unknown R² policy {policy!r}")
    return F.when(total > 0, 1 - ratio(residual, total)).otherwise(flat)


def accuracy(
    df: DataFrame,
    keys: list[str],
    zero_policy: str = "nonzero",
    r2_policy: str = "zero",
    pred: str = "yhat",
    actual: str = "y",
) -> DataFrame:
    """n, mae, mse, rmse, bias, mape, r2 and accuracy_pct per key.

    Training reports use ``positive`` and ``score``, the seasonal model
    ``positive`` and ``zero``, the forecast tracker the defaults.
    """
    p, a = F.col(pred), F.col(actual)
    err = p - a
    return (
        pairs(df, pred, actual)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(err)).alias("mae"),
            F.avg(err * err).alias("mse"),
            F.sqrt(F.avg(err * err)).alias("rmse"),
            F.avg(err).alias("bias"),
            F.coalesce(mape(p, a, zero_policy), F.lit(0.0)).alias("mape"),
            r_squared(p, a, r2_policy).alias("r2"),
        )
        .withColumn("accuracy_pct", F.greatest(F.lit(0.0), 100 - F.col("mape")))
    )


def target_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rounded figures per target; targets whose actuals are all zero are left out."""
    p, a = F.col("yhat"), F.col("y")
    err = a - p
    return (
        df.groupBy(*keys)
        .agg(
            F.count_if(a != 0).alias("_usable"),
            mape(p, a).alias("_mape"),
            F.avg(F.abs(err)).alias("_mae"),
            F.sqrt(F.avg(err * err)).alias("_rmse"),
            F.when(F.count(F.lit(1)) > 1, F.corr(p, a)).otherwise(F.lit(0.0)).alias("_corr"),
            F.sum(p).alias("_predicted"),
            F.sum(a).alias("_actual"),
        )
        .filter("_usable > 0")
        .select(
            *keys,
            F.col("_mape").alias("raw_mape"),
            F.bround("_mape", 1).alias("mape"),
            F.bround(F.greatest(F.lit(0.0), 100 - F.col("_mape")), 1).alias("accuracy"),
            F.bround("_mae", 1).alias("mae"),
            F.bround("_rmse", 1).alias("rmse"),
            F.bround("_corr", 3).alias("correlation"),
            F.bround("_predicted", 0).alias("total_predicted"),
            F.bround("_actual", 0).alias("total_actual"),
        )
    )


def squared_correlation(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.pow(F.corr("y", "yhat"), 2).alias("r2"))
