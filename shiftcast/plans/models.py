"""Fitted-model and model-metadata queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FORECAST
from ..functions import clock
from ..operators import learned, models, seasonal
from ..session import new_work_path, persist_to_shared
from . import base
from .base import SERIES, Catalog, cte, r, t

catalog = Catalog()

SPEC = seasonal.SeasonalSpec()
ADDITIVE = seasonal.SeasonalSpec(multiplicative=False)
# One value a day has no pattern inside the day.
DAILY = seasonal.SeasonalSpec(multiplicative=False, daily=0, weekday_daily=0, weekend_daily=0, step=24)


def _spec(df: DataFrame, spec: seasonal.SeasonalSpec, horizon: int) -> seasonal.SeasonalSpec:
    """With the holidays of all years of the series and of ``horizon`` hours after them."""
    years = df.agg(F.year(F.min("ts")).alias("first"), F.year(F.max("ts") + clock.hours(horizon)).alias("last")).head()
    if years["first"] is None:
        return spec
    return seasonal.spec_with_calendar(df.sparkSession, spec, years["first"], years["last"])


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task, ts, volume)``: orders per day, whose years the yearly terms need; days without any are 0."""
    days = base.daily_orders(spark, sf_dir)
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    filled = every.join(days, "date", "left")
    return filled.select(
        F.lit("orders").alias("task"), F.col("date").cast("timestamp_ntz").alias("ts"), F.coalesce("n", F.lit(0.0)).alias("volume")
    )


@catalog.query("seasonal_regression_forecast")
def seasonal_regression_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next two days of every site and task with bounds and components."""
    w = base.workload(spark, sf_dir)
    return seasonal.forecast(w, SERIES, 48, _spec(w, SPEC, 48))


@catalog.query("seasonal_regression_accuracy")
def seasonal_regression_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdout accuracy over the last fourteen days, per task by hour and of all orders by day."""
    w, orders = base.workload_all(spark, sf_dir), _orders(spark, sf_dir)
    hourly = seasonal.cross_validate(w, ["task"], _spec(w, ADDITIVE, 0), FORECAST.test_days)
    daily = seasonal.cross_validate(orders, ["task"], _spec(orders, DAILY, 0), FORECAST.test_days, min_valid=1)
    return hourly.unionByName(daily)


@catalog.query("seasonal_components")
def seasonal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted history and one further week, split into its parts; the orders by day."""
    parts = []
    for series, spec in ((base.workload_all(spark, sf_dir), ADDITIVE), (_orders(spark, sf_dir), DAILY)):
        spec = _spec(series, spec, 168)
        fitted = seasonal.fit(series, ["task"], spec)
        parts.append(seasonal.predict(fitted, ["task"], spec, 168, include_history=True).drop("sigma"))
    return parts[0].unionByName(parts[1])


# --- the fitted models against the conditions that define them -------------------


def _design_sql(spec: seasonal.SeasonalSpec) -> dict[str, str]:
    """Each column of the design but the events over ``hour``, ``start`` and ``span``, as both engines read it."""
    scaled, days = "((hour - start) / greatest(span, 1.0))", "(hour / 24.0)"
    weekday = f"(floor({days}) + 3) % 7 < 5"
    out = {"one": "1.0", "time": scaled}
    for k in range(1, spec.changepoints + 1):
        out[f"knot_{k}"] = f"greatest(0.0, {scaled} - {spec.changepoint_range * k / spec.changepoints!r})"
    mask = {"weekday_daily": weekday, "weekend_daily": f"NOT ({weekday})"}
    for block, period in seasonal.PERIODS.items():
        for k in range(1, getattr(spec, block) + 1):
            for f in ("sin", "cos"):
                wave = f"{f}(2 * pi() * {k} * {days} / {period!r})"
                out[f"{block}_{k}_{f}"] = f"(CASE WHEN {mask[block]} THEN {wave} ELSE 0.0 END)" if block in mask else wave
    return out


def _moments_sql(spec: seasonal.SeasonalSpec, source: str) -> str:
    """Mean of each column times the value, per task of ``source``."""
    columns = _design_sql(spec)
    shares = ", ".join(f"avg({x} * y) AS {name}" for name, x in columns.items())
    return (
        f"SELECT task, column_name, {r('moment', 'moment')} FROM (SELECT task, {shares} FROM (SELECT *, min(hour) OVER (PARTITION BY task) AS start, "
        f"max(hour) OVER (PARTITION BY task) - min(hour) OVER (PARTITION BY task) AS span FROM (SELECT task, epoch(ts) / 3600 AS hour, volume AS y FROM {source})) "
        f"GROUP BY task) UNPIVOT (moment FOR column_name IN ({', '.join(columns)}))"
    )


_EVERY_DAY = (
    "SELECT 'orders' AS task, s.ts, coalesce(n, 0) AS volume FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS ts FROM daily) s "
    "LEFT JOIN daily ON daily.date = s.ts::DATE"
)


@catalog.query(
    "seasonal_normal_equations",
    cte("workload_all", "daily", every_day=_EVERY_DAY) + f"{_moments_sql(ADDITIVE, 'workload_all')} UNION ALL {_moments_sql(DAILY, 'every_day')}",
)
def seasonal_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fit is the one solution of: each column's product with the fitted values, and its
    ridge term, gives its product with the values themselves."""
    found = []
    for series, spec in ((base.workload_all(spark, sf_dir), ADDITIVE), (_orders(spark, sf_dir), DAILY)):
        spec = _spec(series, spec, 0)
        fitted = seasonal.fit(series, ["task"], spec)
        said = seasonal.predict(fitted, ["task"], spec, 0, include_history=True)
        rows = said.select("task", (clock.hour_index("ts")).cast("double").alias("hour"), "yhat").join(fitted.drop("sigma"), "task")
        columns = _design_sql(spec)
        means = rows.groupBy("task").agg(
            F.first("beta").alias("beta"), F.first("n").alias("n"), *[F.avg(F.expr(f"{x} * yhat")).alias(name) for name, x in columns.items()]
        )
        weights = {name: w + seasonal.LEAST_WEIGHT for _, name, w in seasonal.column_names(spec)}
        terms = [
            F.struct(F.lit(name).alias("column_name"), (F.col(name) + F.col("beta")[j] * weights[name] / F.col("n")).alias("moment"))
            for j, name in enumerate(columns)
        ]
        found.append(means.select("task", F.explode(F.array(*terms)).alias("t")).select("task", "t.*"))
    return found[0].unionByName(found[1])


@catalog.query(
    "seasonal_forecast_checks",
    cte("workload")
    + f"SELECT site, task, 48 AS hours, 48 AS within_bounds, 48 AS numbered, {t('max(ts) + INTERVAL 1 HOUR', 'first_ts')}, "
    f"{t('max(ts) + INTERVAL 48 HOUR', 'last_ts')} FROM workload GROUP BY ALL",
)
def seasonal_forecast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours forecast for each series, their bounds, and that the parts make up the whole."""
    w = base.workload(spark, sf_dir)
    last = w.groupBy(*SERIES).agg(F.max("ts").alias("last"))
    said = seasonal.forecast(w, SERIES, 48, _spec(w, SPEC, 48)).join(last, SERIES)
    whole = F.expr("(1 + trend) * (1 + yearly) * (1 + weekly) * (1 + other) - 1")
    inside = (F.col("lower") >= 0) & (F.col("lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("upper"))
    adds_up = F.abs(F.greatest(whole, F.lit(0.0)) - F.col("yhat")) < 1e-6 * (1 + F.col("yhat"))
    numbered = F.col("ts") == F.col("last") + clock.hours(F.col("h"))
    return said.groupBy(*SERIES).agg(
        F.count("yhat").alias("hours"), F.count_if(inside & adds_up).alias("within_bounds"), F.count_if(numbered).alias("numbered"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@catalog.query("weekly_effect")
def weekly_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.weekly_effect(seasonal_components(spark, sf_dir), ["task"])


@catalog.query(
    "weekly_effect_checks",
    cte("workload_all") + "SELECT task, 7 AS weekdays, true AS balanced, 7 AS as_coefficients FROM (SELECT DISTINCT task FROM workload_all UNION ALL SELECT 'orders')",
)
def weekly_effect_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect of each weekday over one week: the mean of the fitted waves over its hours, and
    all seven add up to nothing."""
    found = []
    for series, spec in ((base.workload_all(spark, sf_dir), ADDITIVE), (_orders(spark, sf_dir), DAILY)):
        spec = _spec(series, spec, 168)
        fitted = seasonal.fit(series, ["task"], spec)
        said = persist_to_shared(seasonal.predict(fitted, ["task"], spec, 168), "one-week")
        effect = seasonal.weekly_effect(said, ["task"])
        place = [j for j, (block, _, _) in enumerate(seasonal.column_names(spec)) if block == "weekly"]
        waves = [x for name, x in _design_sql(spec).items() if name.startswith("weekly_")]
        hours = said.select("task", F.weekday("ts").alias("day_of_week"), clock.hour_index("ts").cast("double").alias("hour"))
        each = hours.groupBy("task", "day_of_week").agg(*[F.avg(F.expr(x)).alias(f"w{k}") for k, x in enumerate(waves)])
        waved = each.join(fitted.select("task", "beta"), "task")
        expected = sum((F.col("beta")[j] * F.col(f"w{k}") for k, j in enumerate(place)), F.lit(0.0))
        both = effect.join(waved.select("task", "day_of_week", expected.alias("expected"), F.abs(F.col("beta")[place[0]]).alias("size")), ["task", "day_of_week"])
        near = 1e-9 * (1 + F.max("size"))
        found.append(both.groupBy("task").agg(
            F.count("weekly").alias("weekdays"), (F.abs(F.sum("weekly")) < near).alias("balanced"),
            F.count_if(F.abs(F.col("weekly") - F.col("expected")) < 1e-9 * (1 + F.col("size"))).alias("as_coefficients"),
        ))
    return found[0].unionByName(found[1])


# --- the caller's own events ------------------------------------------------------


def _orders_by_priority(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(task, ts, volume)``: orders per day and priority, days without any are 0; and events of
    theirs: days with a large order of that priority, and days with an open one."""
    o = base.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("task"), F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus"
    )
    days = o.groupBy("task", "date").agg(F.count(F.lit(1)).cast("double").alias("n"))
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo IS NOT NULL")
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).crossJoin(F.broadcast(days.select("task").distinct()))
    filled = every.join(days, ["task", "date"], "left")
    series = filled.select("task", F.col("date").cast("timestamp_ntz").alias("ts"), F.coalesce("n", F.lit(0.0)).alias("volume"))
    kinds = {"large order": "o_totalprice > 300000", "open order": "o_orderstatus = 'P'"}
    named = [o.where(on).select("task", "date", F.lit(name).alias("name")) for name, on in kinds.items()]
    return series, named[0].unionByName(named[1])


@catalog.query(
    "seasonal_event_equations",
    cte(
        o="SELECT o_orderpriority AS task, o_orderdate::DATE AS date, o_totalprice, o_orderstatus FROM orders",
        spanned="SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM o",
        ser="SELECT t.task, s.date, coalesce(n, 0) AS y FROM spanned s CROSS JOIN (SELECT DISTINCT task FROM o) t LEFT JOIN (SELECT task, date, count(*) AS n FROM o GROUP BY 1, 2) c USING (task, date)",
        ev="SELECT DISTINCT task, date, 'large order' AS name FROM o WHERE o_totalprice > 300000 UNION ALL SELECT DISTINCT task, date, 'open order' FROM o WHERE o_orderstatus = 'P'",
        kinds="SELECT task, name FROM (SELECT DISTINCT task FROM o), (SELECT DISTINCT name FROM ev)",
    )
    + f"SELECT kinds.task, kinds.name, count(ev.date) AS days, {r('avg(CASE WHEN ev.date IS NULL THEN 0 ELSE y END)', 'moment')} FROM kinds "
    "JOIN ser ON ser.task = kinds.task LEFT JOIN ev ON ev.task = kinds.task AND ev.name = kinds.name AND ev.date = ser.date GROUP BY ALL",
)
def seasonal_event_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each series as regressors: on their days the fitted values and the ridge term
    together make up the values themselves."""
    series, events = _orders_by_priority(spark, sf_dir)
    spec = seasonal.spec_with_events(_spec(series, DAILY, 0), events)
    fitted = seasonal.fit(series, ["task"], spec, events=events)
    said = seasonal.predict(fitted, ["task"], spec, 0, include_history=True, events=events)
    on = events.select("task", F.to_timestamp_ntz(F.col("date").cast("string")).alias("ts"), "name").distinct()
    place = {name: j for j, (_, name, _) in enumerate(seasonal.column_names(spec))}
    weight = 1 / spec.seasonal_scale**2 + seasonal.LEAST_WEIGHT
    terms = [
        F.struct(F.lit(n).alias("name"), (F.col("beta")[place[f"event_{n}"]] * weight / F.col("n")).alias("ridge")) for n in spec.own_events
    ]
    models_ = fitted.select("task", "n", F.explode(F.array(*terms)).alias("e")).select("task", "n", "e.*")
    held = said.join(on, ["task", "ts"]).groupBy("task", "name").agg(F.count(F.lit(1)).alias("days"), F.sum("yhat").alias("total"))
    joined = models_.join(held, ["task", "name"], "left")
    days, total = F.coalesce("days", F.lit(0)), F.coalesce("total", F.lit(0.0))
    return joined.select("task", "name", days.alias("days"), (total / F.col("n") + F.col("ridge")).alias("moment"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workload over all sites, written: forecasts read it many times, the events once."""
    return persist_to_shared(base.workload_all(spark, sf_dir), "history")


@catalog.query("recursive_forecast")
def recursive_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next two days per task, each day's predictions feeding the features of the next."""
    return learned.forecast_recursive(_history(spark, sf_dir), ["task"], 48, FORECAST)


@catalog.query(
    "recursive_forecast_checks",
    cte("workload_all")
    + f"SELECT task, 48 AS hours, 24 AS as_direct, 24 AS as_restarted, 48 AS within_bounds, {t('max(ts) + INTERVAL 1 HOUR', 'first_ts')}, "
    f"{t('max(ts) + INTERVAL 48 HOUR', 'last_ts')} FROM workload_all GROUP BY task",
)
def recursive_forecast_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day of the recursion is the direct forecast of the same trees, and the second
    that of a history which ends with the first."""
    w, keys = _history(spark, sf_dir), ["task"]
    span = persist_to_shared(learned.holiday_span(w, 48), "span")
    fitted = {"model": learned.fit_for_block(w, keys, 24, span, FORECAST, "task"), "span": span}
    said = persist_to_shared(learned.forecast_recursive(w, keys, 48, FORECAST, **fitted), "said")
    grown = w.unionByName(said.filter("h <= 24").select("task", "ts", F.col("yhat").alias("volume")))
    others = {"direct": w, "restarted": grown}
    for name, history in others.items():
        other = learned.forecast_boosted(history, keys, 24, FORECAST, **fitted)
        said = said.join(other.select("task", "ts", F.col("yhat").alias(name)), ["task", "ts"], "left")
    same = {n: F.count_if(F.abs(F.col("yhat") - F.col(n)) < 1e-9) for n in others}
    return said.groupBy("task").agg(
        F.count("yhat").alias("hours"), same["direct"].alias("as_direct"), same["restarted"].alias("as_restarted"),
        F.count_if(F.expr("yhat >= 0 AND lower <= yhat AND yhat <= upper")).alias("within_bounds"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@catalog.query("boosted_forecast")
def boosted_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next day per task from boosted trees, the whole horizon in one batch."""
    return learned.forecast_boosted(_history(spark, sf_dir), ["task"], 24, FORECAST)


def _fitted(spark: SparkSession, sf_dir: str) -> learned.BoostedModel:
    w = _history(spark, sf_dir)
    return learned.fit_for_block(w, ["task"], 24, persist_to_shared(learned.holiday_span(w, 24), "span"), FORECAST, "task")


@catalog.query("boosted_accuracy")
def boosted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).metrics


@catalog.query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most important features on average over the tasks; the models
    go through their saved form first."""
    fitted = _fitted(spark, sf_dir)
    path = new_work_path(spark, "models")
    learned.save_boosted(fitted, path)
    loaded = learned.load_boosted(spark, path, list(fitted.models), fitted.columns, ["task"])
    return learned.importance(loaded, spark, 15)


# --- metadata -----------------------------------------------------------------


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task is a model with a version per calendar week it was trained on; the
    version of week 2 is activated again at the end, week 1 is deleted."""
    w = base.workload_all(spark, sf_dir)
    weekly = w.groupBy("task", F.weekofyear("ts").alias("wk")).agg(
        F.count(F.lit(1)).alias("samples"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.avg("volume").alias("mean")
    )
    blank = {
        "model_type": F.lit("seasonal"), "created_by": F.lit("planner"), "data_hash": F.lit(""), "samples": F.col("samples"),
        "first_ts": F.col("first_ts"), "last_ts": F.col("last_ts"),
        "metrics": F.create_map(F.lit("volume"), F.create_map(F.lit("mean"), F.col("mean"))),
    }
    head = [F.col("task").alias("model_id"), F.concat(F.lit("1.0."), F.col("wk")).alias("version")]
    body = [c.alias(n) for n, c in blank.items()]
    made = weekly.select(*head, F.lit("register").alias("event"), F.col("last_ts").alias("at"), *body)
    later = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("at")
    again = weekly.filter("wk = 2").select(*head, F.lit("activate").alias("event"), later, *body)
    gone = weekly.filter("wk = 1").select(*head, F.lit("delete").alias("event"), later, *body)
    return models.log_of([made, again, gone])


_V = {
    "ver": "SELECT task AS model_id, '1.0.' || weekofyear(ts) AS version, weekofyear(ts) AS wk, count(*) AS samples, max(ts) AS created_at, avg(volume) AS mean FROM workload_all WHERE weekofyear(ts) <> 1 GROUP BY 1, 2, 3",
}


@catalog.query("active_models", cte("workload_all", **_V) + f"SELECT model_id, version, samples, {t('created_at', 'created_at')}, {r('mean', 'mean')} FROM ver WHERE wk = 2")
def active_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.current(registry_log(spark, sf_dir))
    return out.select("model_id", "version", "samples", "created_at", F.col("metrics")["volume"]["mean"].alias("mean"))


@catalog.query(
    "model_summary",
    cte("workload_all", **_V)
    + f"SELECT model_id, count(*) AS total_versions, '1.0.2' AS active_version, {t('min(ver.created_at)', 'created_at')}, {t('max(ver.created_at)', 'last_updated')}, 'seasonal' AS model_type, "
    f"{r('max(mean) FILTER (wk = 2)', 'latest_mean')} FROM ver GROUP BY model_id",
)
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.summary(registry_log(spark, sf_dir))
    return out.withColumn("latest_mean", F.col("latest_metrics")["volume"]["mean"]).drop("latest_metrics")


_ROW = "md5(" + " || ".join(f"length({c}) || ':' || {c}" for c in ("site::VARCHAR", "task", "ts::VARCHAR", "volume::VARCHAR")) + ")"


def _half(at: int) -> str:
    return f"sum(('0x' || substr({_ROW}, {at}, 15))::BIGINT::HUGEINT)"


@catalog.query(
    "model_registration",
    cte("workload")
    + f"SELECT 'workload' AS model_id, '1.0.0' AS version, 'register' AS event, {t("TIMESTAMP '2024-02-01 00:00:00'", 'at')}, 'seasonal' AS model_type, 'planner' AS created_by, "
    f"count(*) AS samples, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')}, "
    f"substr(md5(count(*) || '|site,task,ts,volume|' || {_half(1)} || '|' || {_half(17)}), 1, 12) AS data_hash, true AS order_free FROM workload",
)
def model_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration row of a model trained on the whole workload; its fingerprint
    must not change when the rows come in another order."""
    w = base.workload(spark, sf_dir)
    row = models.registration(w, "workload", "1.0.0", "2024-02-01 00:00:00", "seasonal", "planner")
    again = models.fingerprint(w.orderBy(F.desc("ts"), "task", "site")).select(F.col("data_hash").alias("_again"))
    return row.crossJoin(F.broadcast(again)).select(
        "model_id", "version", "event", "at", "model_type", "created_by", "samples", "first_ts", "last_ts",
        "data_hash", (F.col("data_hash") == F.col("_again")).alias("order_free"),
    )
