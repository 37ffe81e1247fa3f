"""Writers and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import capacity, rollups


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One folder of CSV parts, each with a header; quotes inside values are doubled."""
    df.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_sorted(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", **options: str) -> None:
    """Total order over the files: their names ascend with the ranges they hold, their rows are sorted.

    ``by`` goes on until it tells rows apart, so that a time with very many rows spreads
    over several files. Statistics in Parquet files then let a range skip the others.
    """
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.format(fmt).options(**options).save(path)


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of Parquet files with ``place``: their number in the order of the files, from 1.

    One row per file is what the numbers come from; the rows are not moved for it.
    """
    rows = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    files = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(offsets, "_file").withColumn("place", F.col("_before") + F.col("_row") + 1)
    return placed.drop("_file", "_row", "_before")


def write_hourly(df: DataFrame, path: str) -> None:
    """The hourly table partitioned by month, each month in ranges of time: the usual starting
    point of all further operators, so that raw records are read once."""
    rest = [c for c in df.columns if c != "ts"]
    monthly = df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    ordered = monthly.repartitionByRange("month", "ts", *rest).sortWithinPartitions("month", "ts")
    ordered.write.partitionBy("month").parquet(path)


def read_hourly(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Hours from ``start`` to ``end``, both included; whole months are skipped unread."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("month") >= start[:7]).filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col("month") <= end[:7]).filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return df.drop("month")


def report(
    forecast: DataFrame, plan: DataFrame, history: DataFrame, history_columns: list[str], metrics: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The tables of a full report by name."""
    sheets = {
        "forecast": forecast,
        "hourly_plan": plan,
        "daily_summary": plan.groupBy(F.to_date("ts").alias("date")).agg(
            F.sum("total_volume").alias("total_volume"), F.max("total_agents").alias("peak_agents"),
            F.bround(F.avg("total_agents"), 1).alias("avg_agents"),
        ),
        "weekly_summary": capacity.weekly_plan(plan, []),
        "historical_daily": rollups.daily_totals(history, [], history_columns),
    }
    if metrics is not None:
        sheets["metrics"] = metrics
    return sheets


def write_report(sheets: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each table into its own folder."""
    for name, df in sheets.items():
        target = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            write_csv(df, target)
        else:
            df.write.format(fmt).save(target)
