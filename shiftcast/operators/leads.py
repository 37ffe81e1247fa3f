"""Lead history and monthly business targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio


def _ordered(df: DataFrame, date: str) -> DataFrame:
    """Growth over the previous period. The history has one row per period, so
    the single window partition is as long as the calendar, not as the data."""
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    return df.withColumns(
        {
            "_n": F.row_number().over(w),
            "growth_pct": (ratio(F.col("leads").cast("double"), F.lag("leads").over(w)) - 1) * 100,
        }
    )


def growth(df: DataFrame, date: str = "date", recent: int = 3, min_rows: int = 4) -> DataFrame:
    """Mean growth, mean of the last periods, direction and total growth."""
    rows = _ordered(df, date)
    total = rows.agg(F.max("_n").alias("_rows"))
    late = F.when(F.col("_n") > F.col("_rows") - recent, F.col("growth_pct"))
    out = rows.crossJoin(F.broadcast(total)).agg(
        F.max("_rows").alias("n"),
        F.avg("growth_pct").alias("avg_growth"),
        F.avg(late).alias("_recent"),
        F.avg("leads").alias("avg_leads"),
        F.sum("leads").cast("bigint").alias("total_leads"),
        ((ratio(F.max_by("leads", date).cast("double"), F.min_by("leads", date)) - 1) * 100).alias("total_growth"),
    )
    recent_growth = F.when(F.col("n") >= min_rows, F.col("_recent")).otherwise(F.col("avg_growth"))
    return (
        out.withColumn("recent_growth", recent_growth)
        .withColumn(
            "trend",
            F.when(F.col("recent_growth") > 0, "rising").when(F.col("recent_growth") < 0, "falling").otherwise("stable"),
        )
        .drop("_recent")
    )


def trend_line(df: DataFrame, value: str = "leads", date: str = "date") -> DataFrame:
    """Least-squares line over the period number, beside each period."""
    numbered = df.withColumn("_x", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1).cast("double"))
    line = numbered.agg(F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"))
    return numbered.crossJoin(F.broadcast(line)).select(
        date, value, "slope", "intercept", (F.col("intercept") + F.col("slope") * F.col("_x")).alias("trend")
    )


def adjusted(df: DataFrame) -> DataFrame:
    """Leads after growth, rounded half to even, and the difference."""
    return df.withColumn(
        "adjusted_leads", F.bround(F.col("leads") * (1 + F.col("growth_pct") / 100)).cast("bigint")
    ).withColumn("difference", F.col("adjusted_leads") - F.col("leads"))


def yearly_metrics(monthly: DataFrame) -> DataFrame:
    """Leads, adjusted leads and mean of the positive contact rates per year."""
    rate = F.when(F.col("contact_rate") > 0, F.col("contact_rate"))
    return monthly.groupBy(F.year("month").alias("year")).agg(
        F.sum("leads").alias("total_leads"),
        F.sum("adjusted_leads").alias("total_adjusted"),
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("avg_contact_rate"),
    )


def apply_mean_growth(monthly: DataFrame, date: str = "month") -> DataFrame:
    """Every month takes the mean growth of the whole history, to one decimal."""
    mean = _ordered(monthly.drop("growth_pct"), date).agg(F.bround(F.avg("growth_pct"), 1).alias("growth_pct"))
    return monthly.drop("growth_pct").crossJoin(F.broadcast(mean))
