"""Learned forecasters: boosted trees over all series of a task, straight or recursive."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FORECAST, ForecastConfig
from ..functions import clock
from ..functions.numbers import non_negative, ratio
from ..session import new_work_path, persist_to_shared
from . import features, forecast, metrics

WEEK = 168
#: More models than this are no longer a few tasks; each is a sequence of jobs of its own.
MOST_MODELS = 200


@dataclass(frozen=True)
class BoostedModel:
    """One regressor per target value, its holdout figures and residual spread."""

    models: dict[str, GBTRegressionModel]
    columns: list[str]
    keys: list[str]
    by: str
    metrics: DataFrame
    sigma: DataFrame


def lags_beyond(block: int, config: ForecastConfig = FORECAST) -> list[int]:
    """Lags known ``block`` hours ahead: the configured ones, days for those of a few hours."""
    if block == 1:
        return sorted({*config.lag_hours, 2 * WEEK})
    day, week = ceil(block / 24) * 24, ceil(block / WEEK) * WEEK
    return sorted({day, day + 24, day + 48, week, week + WEEK, *(k for k in config.lag_hours if k >= block)})


def memory_hours(block: int, config: ForecastConfig = FORECAST) -> int:
    """How far back the features of a block look."""
    weeks = ceil(block / WEEK) * WEEK
    return max(max(lags_beyond(block, config)), max(config.rolling_windows) + block - 1, weeks + 3 * WEEK)


def holiday_span(df: DataFrame, horizon: int) -> DataFrame:
    """Days whose holidays count: from a month before the first hour to a month after the horizon.

    Fixed once for a model, so that a day has the same distances in training and in every block.
    """
    month = features.NO_HOLIDAY_DAYS * 24
    return df.agg((F.min("ts") - clock.hours(month)).alias("lo"), (F.max("ts") + clock.hours(horizon + month)).alias("hi"))


def model_features(
    df: DataFrame, keys: list[str], block: int, span: DataFrame, config: ForecastConfig = FORECAST, column: str = "volume",
) -> tuple[DataFrame, list[str]]:
    """Features known ``block`` hours ahead: calendar, waves, holidays, lags no shorter than the
    block, spread of the windows that end before it, and the mean of the same hour of four weeks.

    With a block of one hour they are those of the step-by-step forecast; with a longer one a
    whole block is one batch. All ordered features share one exchange and one sort per series.
    """
    out = features.add_cyclical(features.add_time(df))
    lags = lags_beyond(block, config)
    w = Window.partitionBy(*keys).orderBy("ts")
    first = ceil(block / WEEK)
    weeks = [F.lag(column, WEEK * (first + n)).over(w) for n in range(4)]
    known = sum((x.isNotNull().cast("int") for x in weeks[1:]), weeks[0].isNotNull().cast("int"))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in weeks[1:]), F.coalesce(weeks[0], F.lit(0.0)))
    made = {f"{column}_lag_{k}h": F.lag(column, k).over(w) for k in lags}
    made[f"{column}_same_hour_mean"] = ratio(total, known.cast("double"))
    for size in config.rolling_windows:
        before = w.rowsBetween(-(size + block - 1), -block)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            made[f"{column}_roll_{name}_{size}h"] = f(column).over(before)
    out = out.withColumns(made)
    out = features.add_holidays(out, bounds=span)
    kept = {*df.columns, *keys, "ts", column}
    return out, [c for c in out.columns if c not in kept]


def _assembler(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")


def _written_by(df: DataFrame, by: str, label: str) -> DataFrame:
    """Written in a folder per value of ``by``, so that a model reads its own rows only."""
    path = new_work_path(df.sparkSession, label)
    ordered = df.select(*[c for c in df.columns if c != by], by)
    ordered.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def best_round(losses: list[float], patience: int) -> int:
    """Number of rounds with the least loss, before ``patience`` rounds bring nothing better."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def _fit_one(rows: DataFrame, column: str, config: ForecastConfig) -> GBTRegressionModel:
    """Boosts until ``patience`` rounds bring nothing better on the check hours, cut after the best.

    Rounds do not depend on how many follow, so the first try is short, a longer one
    follows only where the loss still falls, and the ensemble cut after its best round is
    the fit of so many rounds.
    """
    train, check = rows.filter("NOT _check"), rows.filter("_check")
    rounds = min(config.max_iter, 2 * config.patience)
    trees = GBTRegressor(
        labelCol=column, featuresCol="features", stepSize=config.step_size, maxDepth=config.max_depth, seed=config.seed,
    )
    while True:
        model = trees.copy({trees.maxIter: rounds}).fit(train)
        best = best_round(model.evaluateEachIteration(check, "squared"), config.patience)
        if best + config.patience <= rounds or rounds >= config.max_iter:
            break
        rounds = min(config.max_iter, 2 * rounds)
    return model if best == rounds else trees.copy({trees.maxIter: best}).fit(train)


def fit_boosted(
    table: DataFrame, columns: list[str], keys: list[str], by: str = "task", column: str = "volume",
    config: ForecastConfig = FORECAST,
) -> BoostedModel:
    """Boosted trees per value of ``by``, trained over all its series.

    The last ``test_days`` of each series are held out, of a series too short for that
    nothing, and it is judged on what it was trained on. A tenth of the training hours,
    chosen by hash, stops the boosting.
    """
    filled = features.fill_gaps(table, keys, columns)
    whole = Window.partitionBy(*keys)
    held = config.test_days * 24
    late = F.col("ts") > F.max("ts").over(whole) - clock.hours(held)
    enough = F.count(F.lit(1)).over(whole) >= held + config.min_train_hours
    assembled = _assembler(columns).transform(
        filled.withColumn("_long", enough).withColumn("_test", late & F.col("_long"))
        .withColumn("_check", F.pmod(F.xxhash64("ts"), F.lit(10)) == 0)
    ).select(*keys, "ts", column, "_long", "_test", "_check", "features")
    # Boosting reads the table many times; a written copy outlives lost executors.
    ready = _written_by(assembled, by, "training")
    names = [r[0] for r in ready.select(by).distinct().orderBy(by).limit(MOST_MODELS + 1).collect()]
    if len(names) > MOST_MODELS:
        raise ValueError(f"more than {MOST_MODELS} values of {by}: choose a coarser one to train by")
    # The fits are independent job sequences; a few threads keep the cluster busy.
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(names)))) as pool:
        fits = pool.map(lambda n: _fit_one(ready.filter((F.col(by) == n) & ~F.col("_test")), column, config), names)
        models = dict(zip(names, fits))
    judged = _apply(models, ready.filter("_test OR NOT _long"), by).select(*keys, "ts", "yhat", F.col(column).alias("y"))
    judged = persist_to_shared(judged, "judged")
    sigma = forecast.residual_sigma(judged.withColumn("residual", F.col("y") - F.col("yhat")), keys)
    return BoostedModel(models, columns, keys, by, metrics.accuracy(judged, [by], "positive", "score"), sigma)


def _apply(models: dict[str, GBTRegressionModel], ready: DataFrame, by: str) -> DataFrame:
    """Each row is scored by its own model only; rows without a model have none."""
    scored = [
        model.setPredictionCol("yhat").transform(ready.filter(F.col(by) == name)).withColumn("yhat", non_negative("yhat"))
        for name, model in models.items()
    ]
    empty = ready.filter("false").withColumn("yhat", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, scored, empty)


def predict_boosted(model: BoostedModel, table: DataFrame, only: str = "true") -> DataFrame:
    """Predictions for those rows that ``only`` selects, never below zero.

    The table carries the model's features and the history that fills their gaps.
    """
    filled = features.fill_gaps(table, model.keys, model.columns).filter(only)
    ready = _written_by(_assembler(model.columns).transform(filled), model.by, "features")
    return _apply(model.models, ready, model.by).drop("features")


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter("volume IS NOT NULL").select(*keys, "ts", F.col("volume").cast("double").alias("volume"))


def _long_enough(df: DataFrame, keys: list[str], config: ForecastConfig) -> DataFrame:
    known = F.count("volume").over(Window.partitionBy(*keys))
    return df.withColumn("_known", known).filter(F.col("_known") > config.min_train_hours).drop("_known")


def fit_for_block(df: DataFrame, keys: list[str], block: int, span: DataFrame, config: ForecastConfig, by: str) -> BoostedModel:
    """The model whose features are known ``block`` hours ahead, from the history of the long series."""
    table, columns = model_features(_long_enough(_known(df, keys), keys, config), keys, block, span, config)
    return fit_boosted(table, columns, keys, by, config=config)


def forecast_boosted(
    df: DataFrame, keys: list[str], horizon: int, config: ForecastConfig = FORECAST, by: str = "task",
    confidence: float = 0.95, model: BoostedModel | None = None, span: DataFrame | None = None,
) -> DataFrame:
    """Direct forecast with bounds: fit on the history, predict the whole horizon in one batch.

    A fitted ``model`` comes with the ``span`` of holidays it was fitted with.
    """
    span = span or persist_to_shared(holiday_span(df, horizon), "span")
    model = model or fit_for_block(df, keys, horizon, span, config, by)
    future = features.append_future(_long_enough(_known(df, keys), keys, config), keys, horizon)
    ahead = predict_boosted(model, model_features(future, keys, horizon, span, config)[0], "volume IS NULL")
    first = F.min(clock.hour_index("ts")).over(Window.partitionBy(*keys))
    numbered = ahead.withColumn("h", (clock.hour_index("ts") - first + 1).cast("int")).select(*keys, "ts", "h", "yhat")
    return forecast.with_intervals(numbered, keys, model.sigma, confidence)


def forecast_recursive(
    df: DataFrame, keys: list[str], horizon: int, config: ForecastConfig = FORECAST, by: str = "task",
    confidence: float = 0.95, block: int = 24, model: BoostedModel | None = None, span: DataFrame | None = None,
) -> DataFrame:
    """The fitted trees block after block, each block's predictions feeding the features of the next.

    The state is a written table of the last hours of every series, as many as the features
    look back. A block of all series is one batch ``transform``; it is appended to the state,
    which then loses its oldest hours. With ``block=1`` every hour feeds the next one. The
    work of a block does not depend on the length of the history.

    Returns ``(keys, ts, h, yhat, lower, upper, reason)``. Series without more than
    ``min_train_hours`` values have no forecast but the reason ``too_short``.
    """
    span = span or persist_to_shared(holiday_span(df, horizon), "span")
    model = model or fit_for_block(df, keys, block, span, config, by)
    dense = _known(df, keys)
    memory = memory_hours(block, config)
    whole = Window.partitionBy(*keys)

    def newest(rows: DataFrame) -> DataFrame:
        cut = F.max("ts").over(whole) - clock.hours(memory)
        return rows.withColumn("_cut", cut).filter(F.col("ts") > F.col("_cut")).drop("_cut")

    state = newest(_long_enough(dense, keys, config)).withColumn("h", F.lit(None).cast("int"))
    state, blocks = persist_to_shared(state, "state-0"), []
    for done in range(0, horizon, block):
        size = min(block, horizon - done)
        future = features.append_future(state.drop("h"), keys, size)
        ahead = predict_boosted(model, model_features(future, keys, block, span, config)[0], "volume IS NULL")
        place = F.row_number().over(whole.orderBy("ts")) + done
        said = ahead.select(*keys, "ts", F.col("yhat").alias("volume"), place.cast("int").alias("h"))
        state = persist_to_shared(newest(state.unionByName(said)), f"state-{done + size}")
        blocks.append(state.filter(f"h > {done}"))
    found = reduce(DataFrame.unionByName, blocks).select(*keys, "ts", "h", F.col("volume").alias("yhat"))
    bounded = forecast.with_intervals(found, keys, model.sigma, confidence)
    nothing = {c: F.lit(None).cast("double").alias(c) for c in bounded.columns if c not in (*keys, "ts", "h")}
    short = dense.groupBy(*keys).agg(F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    short = short.filter(F.col("n") <= config.min_train_hours).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    short = short.withColumn("ts", F.col("last") + clock.hours(F.col("h")))
    short = short.select(*[nothing.get(c, F.col(c)) for c in bounded.columns], F.lit("too_short").alias("reason"))
    return bounded.withColumn("reason", F.lit(None).cast("string")).unionByName(short)


def importance(model: BoostedModel, spark, k: int | None = None) -> DataFrame:
    """Feature importance per target and on average, largest first."""
    rows = [
        (name, c, float(v)) for name, m in model.models.items() for c, v in zip(model.columns, m.featureImportances.toArray())
    ]
    long = spark.createDataFrame(rows, "target string, feature string, importance double")
    wide = long.groupBy("feature").agg(
        *[F.max(F.when(F.col("target") == n, F.col("importance"))).alias(f"{n}_importance") for n in model.models],
        F.avg("importance").alias("avg_importance"),
    ).orderBy(F.desc("avg_importance"), "feature")
    return wide.limit(k) if k else wide


def save_boosted(model: BoostedModel, path: str) -> None:
    """Models through MLlib persistence; figures and spread as Parquet beside them."""
    for name, m in model.models.items():
        m.write().overwrite().save(f"{path}/model={name}")
    model.metrics.write.parquet(f"{path}/metrics")
    model.sigma.write.parquet(f"{path}/sigma")


def load_boosted(spark, path: str, names: list[str], columns: list[str], keys: list[str], by: str = "task") -> BoostedModel:
    models = {n: GBTRegressionModel.load(f"{path}/model={n}") for n in names}
    return BoostedModel(models, columns, keys, by, spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/sigma"))
