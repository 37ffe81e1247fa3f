"""Live hourly workload and forecast monitoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock
from ..session import new_work_path


#: Files of a batch, unless a caller says otherwise: what bounds the work between two checkpoints.
FILES_PER_BATCH = 64


def read_records(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def live_hourly(stream: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "2 hours") -> DataFrame:
    """Records per key and hour. An hour is final once the watermark has passed
    it; later records for it are dropped, which also bounds the state."""
    return (
        stream.select(*keys, clock.as_instant(ts).alias("_at"))
        .withWatermark("_at", lateness)
        .groupBy(F.window("_at", "1 hour"), *keys)
        .agg(F.count(F.lit(1)).cast("double").alias("volume"))
        .select(*keys, clock.from_instant("window.start").alias("ts"), "volume")
    )


class Closing:
    """Lets a stream that is to end give out its last, still open windows.

    The watermark follows the newest record, so nothing after it ever closes what is
    open at the end. ``stream`` is the records together with a folder that is empty
    while they arrive; ``close`` puts one row there whose time lies past all of them
    and whose other columns are NULL. Its own window stays open and is never given out.
    """

    def __init__(self, records: DataFrame, label: str, ts: str = "ts") -> None:
        self.spark, self.schema, self.ts = records.sparkSession, records.schema, ts
        self.path = new_work_path(self.spark, f"{label}-closing")
        self.spark.createDataFrame([], self.schema).write.parquet(self.path)
        self.stream = records.unionByName(self.spark.readStream.schema(self.schema).parquet(self.path))

    def close(self, at) -> None:
        row = [at if f.name == self.ts else None for f in self.schema.fields]
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in self.schema.fields])
        self.spark.createDataFrame([row], loose).write.mode("append").parquet(self.path)


def write_available(
    stream: DataFrame, label: str, partition_by: list[str] | None = None, close: Callable[[], None] | None = None,
    settings: dict[str, str] | None = None,
) -> str:
    """Runs the stream over everything present into a new Parquet folder; returns its path.

    With ``close`` the stream goes on once more after it, to give out what was open.
    ``settings`` hold for this stream only: the session has its own again when it has started.
    """
    spark = stream.sparkSession
    settings = settings or {}
    path = new_work_path(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", f"{path}-progress"
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for before in (None, close) if close else (None,):
        if before:
            before()
        own = {name: spark.conf.get(name, None) for name in settings}
        for name, value in settings.items():
            spark.conf.set(name, value)
        try:
            query = writer.trigger(availableNow=True).start()
        finally:
            for name, value in own.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        query.awaitTermination()
    return path


def monitor(
    stream: DataFrame, forecast: DataFrame, keys: list[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Joins each batch of final hours with a stored forecast and writes its errors.

    A batch overwrites its own folder, so a batch that is run again after a
    failure leaves no duplicates.
    """

    def judge(batch: DataFrame, number: int) -> None:
        joined = batch.withColumnRenamed("volume", "y").join(forecast.select(*keys, "ts", "yhat"), [*keys, "ts"])
        errors = joined.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.abs(F.col("yhat") - F.col("y"))).alias("abs_error"),
            F.sum(F.col("yhat") - F.col("y")).alias("error"),
        )
        errors.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        .foreachBatch(judge).trigger(availableNow=True).start()
    )


def monitor_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Mean absolute error and bias over all batches so far."""
    n = F.sum("n")
    return spark.read.parquet(path).groupBy(*keys).agg(
        n.alias("n"), (F.sum("abs_error") / n).alias("mae"), (F.sum("error") / n).alias("bias")
    )
