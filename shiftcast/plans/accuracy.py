"""Forecast, accuracy, tracking, quality and diagnostics queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, numbers
from ..functions.numbers import non_negative, z_score
from ..operators import diagnostics, forecast, hourly, metrics, quality, quantiles, rollups, tracking
from ..session import new_work_path, persist_to_shared
from . import base
from .base import SERIES, Catalog, cte, d, i, r, t
from .rollups import OUTLOOK_DAYS, outlook_days

catalog = Catalog()

HORIZON = 9 * 24

# --- pattern forecasts --------------------------------------------------------


@catalog.query("seasonal_naive", cte("compared") + f"SELECT task, {t()}, {r('yhat', 'yhat')}, {r('y', 'y')} FROM compared")
def seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last week before the origin, repeated nine days, beside the actuals."""
    return base.compared(spark, sf_dir)


def _past(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.history_and_actuals(spark, sf_dir)[0]


_PAST = "SELECT task, ts, volume, origin, date_diff('hour', ts, origin) AS back FROM workload_all, split WHERE ts < origin"
_PROFILE = "SELECT task, origin, ((-back) % 168 + 168) % 168 AS slot, avg(volume) AS yhat FROM past {} GROUP BY ALL"
_LAID = f"SELECT task, origin, slot + 168*w + 1 AS h, yhat FROM prof, range(2) x(w) WHERE slot + 168*w + 1 <= {HORIZON}"


@catalog.query(
    "week_profile_forecast",
    cte("workload_all", "split", past=_PAST, prof=_PROFILE.format(""), laid=_LAID)
    + f"SELECT task, {t('origin + to_hours((h-1)::INT)')}, h, {r('yhat', 'yhat')} FROM laid",
)
def week_profile_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each hour of the week over the whole history."""
    past = _past(spark, sf_dir)
    return forecast.week_profile(past, ["task"], HORIZON, past)


@catalog.query(
    "four_week_mean_forecast",
    cte("workload_all", "split", past=_PAST, prof=_PROFILE.format("WHERE back <= 672"), laid=_LAID)
    + f"SELECT task, {t('origin + to_hours((h-1)::INT)')}, h, {r('yhat', 'yhat')} FROM laid",
)
def four_week_mean_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = _past(spark, sf_dir)
    return forecast.week_profile(past, ["task"], HORIZON, past, weeks_back=4)


_ADJ = "SELECT * FROM (VALUES ('calls', 10.0::DOUBLE), ('emails', -5.0::DOUBLE), ('outbound_ook', 20.0::DOUBLE), ('outbound_omk', 20.0::DOUBLE), ('outbound_nb', 20.0::DOUBLE)) a(task, pct)"


@catalog.query(
    "adjusted_forecast",
    cte("compared", adj=_ADJ) + f"SELECT task, {t()}, {r('yhat*(1+pct/100)', 'yhat')} FROM compared JOIN adj USING (task)",
)
def adjusted_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent adjustments by column family; all outbound tasks share one."""
    rows = base.compared(spark, sf_dir).drop("y")
    pct = forecast.family_factor(F.col("task"), 10.0, -5.0, 20.0)
    return rows.withColumn("yhat", F.col("yhat") * (1 + pct / 100))


@catalog.query(
    "clamped_adjustment",
    cte("compared") + f"SELECT task, {t()}, {r('greatest(0, yhat - 4)', 'yhat')} FROM compared",
)
def clamped_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat cut of four contacts per hour, never below zero."""
    return base.compared(spark, sf_dir).select("task", "ts", non_negative(F.col("yhat") - 4).alias("yhat"))


_Z = z_score(0.95)
_INTERVALS = {
    "sig": "SELECT task, stddev_pop(y - yhat) AS sigma FROM compared GROUP BY task",
    "iv": f"SELECT c.task, ts, date_diff('hour', origin, ts) + 1 AS h, yhat, {_Z!r}::DOUBLE*sigma*(1+sqrt((date_diff('hour', origin, ts)+1)/24.0::DOUBLE)*0.5) AS w FROM compared c JOIN sig USING (task), split",
}


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = base.compared(spark, sf_dir)
    sigma = forecast.residual_sigma(both.withColumn("residual", F.col("y") - F.col("yhat")), ["task"])
    first = F.min(clock.hour_index("ts")).over(Window.partitionBy("task"))
    ahead = both.withColumn("h", (clock.hour_index("ts") - first + 1).cast("int")).drop("y")
    return forecast.with_intervals(ahead, ["task"], sigma)


@catalog.query(
    "forecast_intervals",
    cte("compared", **_INTERVALS)
    + f"SELECT task, {t()}, h, {r('yhat', 'yhat')}, {r('greatest(0, yhat-w)', 'lower')}, {r('yhat+w', 'upper')} FROM iv",
)
def forecast_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the residual spread, growing with the horizon."""
    return intervals(spark, sf_dir)


@catalog.query(
    "interval_widths",
    cte("compared", **_INTERVALS, b="SELECT task, yhat, yhat + w - greatest(0, yhat-w) AS wd FROM iv")
    + f"SELECT task, {r('avg(wd)', 'avg_width')}, {r('max(wd)', 'max_width')}, {r('min(wd)', 'min_width')}, {r('avg(yhat)', 'avg_prediction')}, {r('avg(wd)/avg(yhat)*100', 'relative_pct')} FROM b GROUP BY task",
)
def interval_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.interval_widths(intervals(spark, sf_dir), ["task"])


# --- accuracy -----------------------------------------------------------------

_POLICY = {"positive": "FILTER (y > 0)", "nonzero": "FILTER (y <> 0)"}


def accuracy_sql(zero: str, r2: str, keys: str = "task", source: str = "compared") -> str:
    flat = "CASE WHEN sum((y-yhat)*(y-yhat)) = 0 THEN 1 ELSE 0 END" if r2 == "score" else "0"
    mape = f"coalesce(avg(abs((yhat-y)/nullif(y,0))) {_POLICY[zero]}, 0)*100"
    return (
        f"SELECT {keys}, count(*) AS n, {r('avg(abs(yhat-y))', 'mae')}, {r('avg((yhat-y)*(yhat-y))', 'mse')}, {r('sqrt(avg((yhat-y)*(yhat-y)))', 'rmse')}, {r('avg(yhat-y)', 'bias')}, "
        f"{r(mape, 'mape')}, {r(f'CASE WHEN var_pop(y) > 0 THEN 1 - sum((y-yhat)*(y-yhat))/(var_pop(y)*count(*)) ELSE {flat} END', 'r2')}, "
        f"{r(f'greatest(0, 100 - {mape})', 'accuracy_pct')} FROM {source} GROUP BY {keys}"
    )


for _name, _zero, _r2 in (("training", "positive", "score"), ("seasonal_model", "positive", "zero"), ("tracker", "nonzero", "zero")):

    @catalog.query(f"accuracy_{_name}", cte("compared") + accuracy_sql(_zero, _r2))
    def accuracy(spark: SparkSession, sf_dir: str, zero: str = _zero, r2: str = _r2) -> DataFrame:
        """Accuracy per task under one of the policies for zero actuals and flat series."""
        return metrics.accuracy(base.compared(spark, sf_dir), ["task"], zero, r2)


_QUALITY = (
    "SELECT task, avg(abs((y-yhat)/nullif(y,0)))*100 AS m, avg(abs(y-yhat)) AS mae, sqrt(avg((y-yhat)*(y-yhat))) AS rmse, corr(yhat, y) AS c, sum(yhat) AS p, sum(y) AS a "
    "FROM compared GROUP BY task HAVING count(*) FILTER (y <> 0) > 0"
)


@catalog.query(
    "target_quality",
    cte("compared", q=_QUALITY)
    + f"SELECT task, {r('m', 'raw_mape')}, {r('round_even(m, 1)', 'mape')}, {r('round_even(greatest(0, 100-m), 1)', 'accuracy')}, {r('round_even(mae, 1)', 'mae')}, "
    f"{r('round_even(rmse, 1)', 'rmse')}, {r('round_even(c, 3)', 'correlation')}, {r('round_even(p, 0)', 'total_predicted')}, {r('round_even(a, 0)', 'total_actual')} FROM q",
)
def target_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.target_quality(base.compared(spark, sf_dir), ["task"])


@catalog.query("squared_correlation", cte("compared") + f"SELECT task, {r('pow(corr(y, yhat), 2)', 'r2')} FROM compared GROUP BY task")
def squared_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.squared_correlation(base.compared(spark, sf_dir), ["task"])


@catalog.query(
    "mape_by_hour",
    cte("compared") + f"SELECT task, {i('hour(ts)', 'hour')}, {r('coalesce(avg(abs((yhat-y)/nullif(y,0)))*100, 0)', 'mape')} FROM compared GROUP BY task, hour(ts)",
)
def mape_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.mape_by(base.compared(spark, sf_dir), ["task"], "hour")


@catalog.query(
    "mape_by_weekday",
    cte("compared") + f"SELECT task, dayname(ts) AS weekday, {r('coalesce(avg(abs((yhat-y)/nullif(y,0)))*100, 0)', 'mape')} FROM compared GROUP BY task, dayname(ts)",
)
def mape_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = tracking.nested_breakdown(base.compared(spark, sf_dir), ["task"], "weekday")
    return nested.select("task", F.explode("weekday_mape").alias("weekday", "mape"))


# --- forecast store -----------------------------------------------------------

# Forecast id, hour of creation, model version.
STORE = (("naive_day", 1, "1.0.0"), ("naive_week", 2, "1.0.1"), ("four_week_mean", 3, "1.0.2"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forecasts of the same nine days as store points."""
    past = _past(spark, sf_dir)
    made = (
        forecast.repeat_yesterday(past, ["task"], HORIZON, past),
        forecast.repeat_last_week(past, ["task"], HORIZON, past),
        forecast.week_profile(past, ["task"], HORIZON, past, weeks_back=4),
    )
    tagged = [
        f.select(
            F.lit(fid).alias("forecast_id"), F.lit(f"2024-01-22 0{at}:00:00").cast("timestamp_ntz").alias("created_at"),
            F.lit(version).alias("model_version"), "task", "ts", "yhat",
        )
        for f, (fid, at, version) in zip(made, STORE)
    ]
    return reduce(DataFrame.unionByName, tagged)


_STORE = {
    "past": _PAST,
    "prof": _PROFILE.format("WHERE back <= 672"),
    "laid": _LAID,
    "hz": f"SELECT unnest(range(1, {HORIZON + 1})) AS h",
    "store": "SELECT 'naive_day' AS forecast_id, TIMESTAMP '2024-01-22 01:00:00' AS created_at, '1.0.0' AS model_version, task, origin + to_hours((h-1)::INT) AS ts, volume AS yhat "
    "FROM past, hz WHERE back <= 24 AND (h - 1) % 24 = 24 - back UNION ALL "
    "SELECT 'naive_week', TIMESTAMP '2024-01-22 02:00:00', '1.0.1', task, ts, yhat FROM compared UNION ALL "
    "SELECT 'four_week_mean', TIMESTAMP '2024-01-22 03:00:00', '1.0.2', task, origin + to_hours((h-1)::INT), yhat FROM laid",
    "judged": "SELECT s.*, w.volume AS y FROM store s JOIN workload_all w USING (task, ts)",
}


def store_sql(body: str, **extra: str) -> str:
    return cte("compared", **_STORE, **extra) + body


@catalog.query(
    "forecast_list",
    store_sql(f"SELECT forecast_id, {t('created_at', 'created_at')}, model_version, {t('min(ts)', 'forecast_start')}, {t('max(ts)', 'forecast_end')} FROM store GROUP BY forecast_id, store.created_at, model_version ORDER BY store.created_at DESC LIMIT 2"),
)
def forecast_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two newest forecasts, read back from a store partitioned by forecast."""
    path = new_work_path(spark, "forecasts")
    tracking.save_points(store(spark, sf_dir), path)
    return tracking.list_forecasts(tracking.load_points(spark, path), 2)


@catalog.query(
    "forecast_lookup",
    store_sql(f"SELECT forecast_id, {t('created_at', 'created_at')}, model_version, task, {t()}, {r('yhat', 'yhat')} FROM store WHERE forecast_id = 'naive_week'"),
)
def forecast_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast out of the store; only its directory is read."""
    path = new_work_path(spark, "forecasts")
    tracking.save_points(store(spark, sf_dir), path)
    return tracking.load_points(spark, path, "naive_week")


@catalog.query(
    "forecast_export",
    store_sql(f"SELECT forecast_id, {t('created_at', 'created_at')}, model_version, task, {t()}, {r('yhat', 'yhat')} FROM store WHERE forecast_id = 'naive_week'"),
)
def forecast_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast through its nested JSON record and back."""
    one = store(spark, sf_dir).filter("forecast_id = 'naive_week'")
    return tracking.points_from_json(tracking.points_to_json(one))


@catalog.query(
    "forecast_removal",
    store_sql(f"SELECT forecast_id, count(*) AS n, {r('sum(yhat)', 'volume')} FROM store WHERE forecast_id <> 'naive_day' GROUP BY forecast_id"),
)
def forecast_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = tracking.delete_forecast(store(spark, sf_dir), "naive_day")
    return left.groupBy("forecast_id").agg(F.count(F.lit(1)).alias("n"), F.sum("yhat").alias("volume"))


_M = "coalesce(avg(abs((yhat-y)/nullif(y,0))),0)*100"
_SUMMARY = (
    f"SELECT forecast_id, created_at, model_version, task, avg(abs(yhat-y)) AS mae, {_M} AS mape, sqrt(avg((yhat-y)*(yhat-y))) AS rmse, greatest(0, 100-{_M}) AS accuracy_pct, "
    "min(ts) AS fs, max(ts) AS fe FROM judged GROUP BY ALL"
)


@catalog.query(
    "forecast_accuracy_summary",
    store_sql(f"SELECT forecast_id, {t('created_at', 'created_at')}, model_version, task, {r('mae', 'mae')}, {r('mape', 'mape')}, {r('rmse', 'rmse')}, {r('accuracy_pct', 'accuracy_pct')}, "
              f"{t('fs', 'forecast_start')}, {t('fe', 'forecast_end')} FROM sm WHERE created_at >= TIMESTAMP '2024-01-22 02:00:00'", sm=_SUMMARY),
)
def forecast_accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the two newest forecasts in one join."""
    return tracking.accuracy_summary(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"], limit=2)


@catalog.query(
    "error_by_target",
    store_sql(f"SELECT task, {r('avg(mape)', 'mape')} FROM sm GROUP BY task", sm=_SUMMARY),
)
def error_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = tracking.accuracy_summary(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"])
    return tracking.error_by_target(summary, ["task"])


@catalog.query(
    "learning_insights",
    store_sql(
        f"SELECT count(*) AS rows, {r('avg(mape)', 'avg_mape')}, {r('100-avg(mape)', 'avg_accuracy')}, {r('avg(mape) FILTER (k <= 5)', 'recent_mape')}, {r('avg(mape) FILTER (k > n-5)', 'older_mape')}, "
        "CASE WHEN avg(mape) FILTER (k <= 5) < avg(mape) FILTER (k > n-5) THEN 'improving' WHEN avg(mape) FILTER (k <= 5) > 1.1*avg(mape) FILTER (k > n-5) THEN 'declining' END AS trend, 'ok' AS status, "
        "(SELECT string_agg(task, ',' ORDER BY task) FROM (SELECT task FROM sm GROUP BY task HAVING avg(mape) > 20)) AS high_error_targets FROM rk",
        sm=_SUMMARY, rk="SELECT *, row_number() OVER (ORDER BY created_at DESC, forecast_id DESC, task) AS k, count(*) OVER () AS n FROM sm"),
)
def learning_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The insights, with the names of the tasks that miss by more than a fifth for their number."""
    summary = tracking.accuracy_summary(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"], limit=20)
    summary = persist_to_shared(summary, "summary")
    names = F.array_join(F.array_sort(F.collect_list("task")), ",")
    listed = tracking.high_error_targets(summary, ["task"]).agg(F.nullif(names, F.lit("")).alias("high_error_targets"))
    found = tracking.learning_insights(summary, ["task"]).drop("high_error_targets")
    return found.crossJoin(F.broadcast(listed))


@catalog.query(
    "high_error_targets",
    store_sql(f"SELECT task, {r('avg(mape)', 'mape')} FROM sm GROUP BY task HAVING avg(mape) > 20", sm=_SUMMARY),
)
def high_error_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose forecasts miss by more than a fifth on average."""
    summary = tracking.accuracy_summary(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"], limit=20)
    return tracking.high_error_targets(summary, ["task"])


@catalog.query(
    "feedback_history",
    store_sql(f"SELECT {r('avg(mape)', 'avg_mape')}, {r('avg(accuracy_pct)', 'avg_accuracy')}, count(DISTINCT forecast_id) AS n_forecasts_evaluated, {r('max(accuracy_pct)', 'best_accuracy')}, {r('min(accuracy_pct)', 'worst_accuracy')} FROM sm", sm=_SUMMARY),
)
def feedback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics appended to a JSON feedback log as nested maps, then read and averaged."""
    summary = tracking.accuracy_summary(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"])
    entry = F.struct("task", F.create_map(F.lit("mape"), F.col("mape"), F.lit("accuracy"), F.col("accuracy_pct")))
    entries = summary.groupBy("forecast_id", F.col("created_at").alias("timestamp")).agg(
        F.map_from_entries(F.collect_list(entry)).alias("accuracy_metrics")  # one entry per task
    )
    path = new_work_path(spark, "feedback")
    tracking.save_feedback(entries, path)
    return tracking.historical_accuracy(tracking.load_feedback(spark, path))


_OLD = "SELECT site, task, ts, CASE WHEN hour(ts) % 5 > 0 THEN volume END AS volume FROM hourly WHERE ts < TIMESTAMP '2024-01-20 00:00:00'"
_NEW = "SELECT site, task, ts, volume + 100 AS volume FROM hourly WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'"


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES)
    old = h.filter(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).withColumn(
        "volume", F.when(F.hour("ts") % 5 > 0, F.col("volume"))
    )
    new = h.filter(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).withColumn("volume", F.col("volume") + 100)
    return old, new


for _side, _sql in (("existing", "coalesce(o.volume, n.volume)"), ("new", "coalesce(n.volume, o.volume)")):

    @catalog.query(
        f"upsert_prefer_{_side}",
        cte("hourly", o=_OLD, n=_NEW) + f"SELECT site, task, {t()}, {r(_sql, 'volume')} FROM o FULL JOIN n USING (site, task, ts)",
    )
    def upsert(spark: SparkSession, sf_dir: str, side: str = _side) -> DataFrame:
        """Actuals merged by site, task and hour."""
        old, new = _old_and_new(spark, sf_dir)
        return tracking.upsert(old, new, [*SERIES, "ts"], ["volume"], side)


@catalog.query(
    "merge_strategies",
    cte("hourly", o=_OLD, n=_NEW)
    + f"SELECT 'append' AS strategy, count(*) AS n, {r('sum(volume)', 'volume')} FROM (SELECT * FROM o UNION ALL SELECT * FROM n) UNION ALL "
    f"SELECT 'replace', count(*), {r('sum(volume)', 'volume')} FROM n UNION ALL "
    f"SELECT 'merge_by_timestamp', count(*), {r('sum(coalesce(n.volume, o.volume))', 'volume')} FROM o FULL JOIN n USING (site, task, ts)",
)
def merge_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _old_and_new(spark, sf_dir)
    parts = [
        tracking.merge(old, new, [*SERIES, "ts"], ["volume"], s)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))
        .select(F.lit(s).alias("strategy"), "n", "volume")
        for s in ("append", "replace", "merge_by_timestamp")
    ]
    return reduce(DataFrame.unionByName, parts)


# --- outlook ------------------------------------------------------------------


@catalog.query(
    "outlook_accuracy",
    cte("daily", od=OUTLOOK_DAYS, s="SELECT sum(forecast) f, sum(actual) a, sum(forecast+adjustment) z, avg(CASE WHEN actual > 0 THEN abs(forecast-actual)/actual ELSE 0 END)*100 m, "
        "count(*) FILTER (forecast > actual) o, count(*) FILTER (forecast < actual) u FROM od")
    + f"SELECT {r('greatest(0, 100-abs(f-a)/a*100)', 'forecast_accuracy')}, {r('greatest(0, 100-abs(z-a)/a*100)', 'final_accuracy')}, "
    f"{r('greatest(0, 100-abs(z-a)/a*100)-greatest(0, 100-abs(f-a)/a*100)', 'improvement')}, {r('m', 'mape')}, o AS over_forecast, u AS under_forecast FROM s",
)
def outlook_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.outlook_accuracy(outlook_days(spark, sf_dir))


@catalog.query(
    "outlook_error_bands",
    cte("compared", x=f"SELECT task, ts::DATE AS date, sum(yhat) AS f, sum(y) AS a FROM compared GROUP BY ALL", e="SELECT *, (f-a)/CASE WHEN a = 0 THEN 1 ELSE a END*100 AS p FROM x")
    + f"SELECT task, {d()}, {r('f', 'forecast')}, {r('a', 'actual')}, {r('p', 'error_pct')}, CASE WHEN p > 10 THEN 'high' WHEN p > 0 THEN 'moderate' ELSE 'low' END AS band FROM e",
)
def outlook_error_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = base.compared(spark, sf_dir).groupBy("task", F.to_date("ts").alias("date")).agg(
        F.sum("yhat").alias("forecast"), F.sum("y").alias("actual")
    )
    return tracking.error_bands(per_day)


# --- quality ------------------------------------------------------------------

_TRAINING = (
    "SELECT forecast_id, task, coalesce(avg(abs((yhat-y)/nullif(y,0))) FILTER (y > 0), 0)*100 AS mape, CASE WHEN var_pop(y) > 0 THEN 1 - sum((y-yhat)*(y-yhat))/(var_pop(y)*count(*)) ELSE CASE WHEN sum((y-yhat)*(y-yhat)) = 0 THEN 1 ELSE 0 END END AS r2 "
    "FROM judged GROUP BY ALL"
)


@catalog.query(
    "quality_indicator",
    store_sql(
        "SELECT forecast_id, " + r("am", "avg_mape") + ", " + r("score", "score") + ", lv AS level, colour, "
        "array_to_string(list_filter([CASE lv WHEN 'high' THEN 'PATTERNS_CAPTURED' WHEN 'medium' THEN 'PLAN_BUFFER_10_15_PCT' ELSE 'LIMITED_HISTORY' END, "
        "CASE lv WHEN 'high' THEN 'PAST_PREDICTIONS_ACCURATE' WHEN 'medium' THEN 'PATTERNS_VARIABLE' ELSE 'MANUAL_REVIEW' END, 'LONG_HORIZON', "
        "CASE WHEN am < 10 THEN 'ERROR_WITHIN_10_PCT' WHEN am < 20 THEN 'ERROR_WITHIN_20_PCT' ELSE 'ERROR_ABOVE_20_PCT' END], lambda x: x IS NOT NULL), ',') AS codes FROM sl",
        tr=_TRAINING,
        sc="SELECT forecast_id, avg(mape) AS am, round_even(greatest(0, least(100, avg(greatest(0, 100-mape*2))*0.5 + avg(greatest(0, least(100, r2*100)))*0.3 + 95*0.2 - 10)), 1) AS score FROM tr GROUP BY 1",
        sl="SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS lv, CASE WHEN score >= 80 THEN '#10b981' WHEN score >= 60 THEN '#f59e0b' ELSE '#ef4444' END AS colour FROM sc",
    ),
)
def quality_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, level and explanation codes per forecast, 20 days ahead, data quality 95."""
    judged = tracking.compare(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"])
    training = metrics.accuracy(judged, ["forecast_id", "task"], "positive", "score")
    out = quality.indicator(training, ["forecast_id"], data_quality=95.0, horizon_days=20)
    return out.withColumn("codes", F.concat_ws(",", "codes"))


@catalog.query(
    "forecast_verdict",
    store_sql(
        f"SELECT forecast_id, count(*) AS targets, {r('round_even(avg(m), 1)', 'overall_mape')}, {r('round_even(avg(greatest(0, 100-m)), 1)', 'overall_accuracy')}, "
        "CASE WHEN avg(greatest(0, 100-m)) >= 90 THEN 'EXCELLENT' WHEN avg(greatest(0, 100-m)) >= 80 THEN 'GOOD' WHEN avg(greatest(0, 100-m)) >= 70 THEN 'ACCEPTABLE' WHEN avg(greatest(0, 100-m)) >= 60 THEN 'MODERATE' ELSE 'POOR' END AS verdict, "
        "coalesce(string_agg(note, ',' ORDER BY note), '') AS notes FROM nt GROUP BY forecast_id",
        q="SELECT forecast_id, task, avg(abs((y-yhat)/nullif(y,0)))*100 AS m, round_even(sum(yhat),0) AS p, round_even(sum(y),0) AS a FROM judged GROUP BY ALL HAVING count(*) FILTER (y <> 0) > 0",
        nt="SELECT *, CASE WHEN round_even(greatest(0,100-m),1) >= 90 THEN task || ':ACCURATE' WHEN round_even(greatest(0,100-m),1) < 70 AND a - p > 0 THEN task || ':UNDER_FORECAST' WHEN round_even(greatest(0,100-m),1) < 70 THEN task || ':OVER_FORECAST' END AS note FROM q",
    ),
)
def forecast_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = tracking.compare(store(spark, sf_dir), base.workload_all(spark, sf_dir), ["task"])
    return quality.compare(judged, ["forecast_id"]).withColumn("notes", F.concat_ws(",", "notes"))


@catalog.query(
    "peak_detection",
    cte("compared", th="SELECT task, quantile_cont(yhat, 0.75) AS pt, quantile_cont(y, 0.75) AS act FROM compared GROUP BY task",
        c="SELECT task, count(*) FILTER (yhat >= pt AND y >= act) AS tp, count(*) FILTER (yhat >= pt AND y < act) AS fp, count(*) FILTER (yhat < pt AND y >= act) AS fn FROM compared JOIN th USING (task) GROUP BY task")
    + f"SELECT task, tp AS peaks_detected, fn AS peaks_missed, fp AS false_alarms, {r('round_even(coalesce(tp/nullif(tp+fn,0)*100.0::DOUBLE,0),1)', 'detection_rate')}, "
    f"{r('round_even(coalesce(fp/nullif(tp+fp,0)*100.0::DOUBLE,0),1)', 'false_positive_rate')} FROM c",
)
def peak_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.peak_detection(base.compared(spark, sf_dir), ["task"])


# --- diagnostics --------------------------------------------------------------


def _res(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.residuals(base.compared(spark, sf_dir))


_RES = "SELECT *, y - yhat AS residual FROM compared"


@catalog.query(
    "residuals",
    cte("compared", res=_RES) + f"SELECT task, {t()}, {r('yhat', 'yhat')}, {r('y', 'y')}, {r('residual', 'residual')}, {i('hour(ts)', 'hour')}, {i('isodow(ts)-1', 'day_of_week')}, dayname(ts) AS day_name FROM res",
)
def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _res(spark, sf_dir)


_GROUP = (
    f"{r('avg(abs(residual))', 'mae')}, {r('sqrt(avg(residual*residual))', 'rmse')}, {r('avg(residual)', 'bias')}, "
    f"{r('CASE WHEN max(y) > 0 THEN avg(abs(residual/nullif(y,0)))*100 END', 'mape')}, count(*) AS count"
)


@catalog.query("errors_by_hour", cte("compared", res=_RES) + f"SELECT task, {i('hour(ts)', 'hour')}, {_GROUP} FROM res GROUP BY task, hour(ts)")
def errors_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.metrics_by(_res(spark, sf_dir), ["task"], "hour")


@catalog.query("errors_by_weekday", cte("compared", res=_RES) + f"SELECT task, {i('isodow(ts)-1', 'day_of_week')}, {_GROUP} FROM res GROUP BY task, isodow(ts)")
def errors_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.metrics_by(_res(spark, sf_dir), ["task"], "day_of_week")


_MOMENTS = {
    "res": _RES,
    "mu": "SELECT task, avg(residual) AS m FROM res GROUP BY task",
    "mo": "SELECT task, count(*) AS n, avg(pow(residual-m,2)) AS m2, avg(pow(residual-m,3)) AS m3, avg(pow(residual-m,4)) AS m4 FROM res JOIN mu USING (task) GROUP BY task",
    "jb": "SELECT task, n, m3/pow(m2,1.5) AS s, m4/(m2*m2)-3 AS k, n/6.0::DOUBLE*(pow(m3/pow(m2,1.5),2)+pow(m4/(m2*m2)-3,2)/4) AS j FROM mo",
}


@catalog.query(
    "residual_normality",
    cte("compared", **_MOMENTS) + f"SELECT task, n, {r('s', 'skewness')}, {r('k', 'kurtosis')}, {r('j', 'statistic')}, {r('exp(-j/2)', 'p_value')}, exp(-j/2) > 0.05 AS is_normal FROM jb",
)
def residual_normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.normality(_res(spark, sf_dir), ["task"])


_SPREAD = {
    "res": _RES,
    "mid": "SELECT task, median(yhat) AS md FROM compared GROUP BY task",
    "hv": "SELECT res.*, yhat >= md AS hi FROM res JOIN mid USING (task)",
    "ct": "SELECT task, hi, median(residual) AS c FROM hv GROUP BY ALL",
    "z": "SELECT hv.task, hv.hi, abs(residual - c) AS z FROM hv JOIN ct ON hv.task = ct.task AND hv.hi = ct.hi",
    "g": "SELECT task, hi, count(*) AS n, avg(z) AS m FROM z GROUP BY ALL",
    "gm": "SELECT task, avg(z) AS gm, count(*) AS n FROM z GROUP BY task",
    "w": "SELECT z.task, sum(pow(z.z - g.m, 2)) AS within FROM z JOIN g ON z.task = g.task AND z.hi = g.hi GROUP BY z.task",
    "b": "SELECT g.task, sum(g.n*pow(g.m-gm.gm,2)) AS btw, any_value(gm.n) AS n, min(g.n) AS small, count(*) AS k FROM g JOIN gm ON g.task = gm.task GROUP BY g.task",
}


@catalog.query(
    "residual_spread_test",
    cte("compared", **_SPREAD) + f"SELECT b.task, b.n, {r('CASE WHEN k = 2 AND small > 10 THEN (b.n-2)*btw/within END', 'statistic')} FROM b JOIN w ON w.task = b.task",
)
def residual_spread_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.spread_test(_res(spark, sf_dir), ["task"])


# The F distribution with one degree of freedom is that of Student's t squared, whose share inside has a finite
# series in the cosine of the angle atan(t / sqrt(nu)), one for odd and one for even nu.
_STUDENT = _SPREAD | {
    "f": "SELECT b.task, b.n, CASE WHEN k = 2 AND small > 10 THEN (b.n-2)*btw/within END AS f FROM b JOIN w ON w.task = b.task",
    "a": "SELECT *, n - 2 AS nu, atan(sqrt(f / (n - 2))) AS angle FROM f",
    "terms": "SELECT task, unnest(range(0, CASE WHEN nu % 2 = 1 THEN (nu - 1) // 2 ELSE nu // 2 END)) AS j, nu, angle FROM a",
    "logs": "SELECT task, nu, angle, sum(CASE WHEN j = 0 THEN 0 WHEN nu % 2 = 1 THEN ln(2 * j / (2 * j + 1.0)) ELSE ln((2 * j - 1) / (2.0 * j)) END + "
    "CASE WHEN j = 0 THEN 0 ELSE 2 * ln(cos(angle)) END) OVER (PARTITION BY task ORDER BY j) AS l FROM terms",
    "inside": "SELECT task, CASE WHEN any_value(nu) % 2 = 1 THEN 2 / pi() * (any_value(angle) + sin(any_value(angle)) * cos(any_value(angle)) * sum(exp(l))) "
    "ELSE sin(any_value(angle)) * sum(exp(l)) END AS share FROM logs GROUP BY task",
}


@catalog.query(
    "heteroscedasticity",
    cte("compared", **_STUDENT) + f"SELECT f.task, f.n, {r('f', 'statistic')}, {r('1 - share', 'p_value')}, CASE WHEN f IS NOT NULL THEN 1 - share < 0.05 END AS is_heteroscedastic "
    "FROM f JOIN inside USING (task)",
)
def heteroscedasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread test with the p-value of its F distribution."""
    return diagnostics.heteroscedasticity(_res(spark, sf_dir), ["task"])


@catalog.query(
    "residual_statistics",
    cte("compared", res=_RES) + f"SELECT task, {r('avg(residual)', 'mean')}, {r('stddev_pop(residual)', 'std')} FROM res GROUP BY task",
)
def residual_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.residual_statistics(_res(spark, sf_dir), ["task"])


@catalog.query(
    "diagnostic_summary",
    cte("compared", **_MOMENTS,
        o="SELECT task, avg(abs(residual)) a, sqrt(avg(residual*residual)) b, avg(residual) c, stddev_samp(residual) e FROM res GROUP BY task",
        hh="SELECT task, hour(ts) AS k, CASE WHEN max(y) > 0 THEN avg(abs(residual/nullif(y,0)))*100 END AS m FROM res GROUP BY ALL",
        wh="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY m DESC NULLS LAST, k) AS rn FROM hh) WHERE rn = 1",
        dd="SELECT task, isodow(ts)-1 AS k, CASE WHEN max(y) > 0 THEN avg(abs(residual/nullif(y,0)))*100 END AS m FROM res GROUP BY ALL",
        wd="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY m DESC NULLS LAST, k) AS rn FROM dd) WHERE rn = 1")
    + f"SELECT o.task, {r('a', 'mae')}, {r('b', 'rmse')}, {r('c', 'bias')}, {r('e', 'std')}, exp(-j/2) > 0.05 AS is_normal, {i('wh.k', 'worst_hour')}, {r('wh.m', 'worst_hour_mape')}, "
    f"{i('wd.k', 'worst_day_of_week')}, {r('wd.m', 'worst_day_of_week_mape')} FROM o JOIN jb USING (task) JOIN wh USING (task) JOIN wd USING (task)",
)
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.summary(_res(spark, sf_dir), ["task"])


def _poly_sql(x: str, coefs: tuple[float, ...]) -> str:
    return " + ".join(f"({c!r}) * pow({x}, {len(coefs) - 1 - k})" for k, c in enumerate(coefs))


_QUANTILE = (
    "CASE WHEN least(share, 1 - share) >= 0.02425 THEN "
    f"({_poly_sql('pow(share - 0.5, 2)', numbers._ACKLAM_A)}) * (share - 0.5) / (({_poly_sql('pow(share - 0.5, 2)', numbers._ACKLAM_B)}) * pow(share - 0.5, 2) + 1) "
    f"ELSE sign(0.5 - share) * ({_poly_sql('tt', numbers._ACKLAM_C)}) / (({_poly_sql('tt', numbers._ACKLAM_D)}) * tt + 1) END"
)


@catalog.query(
    "residual_qq_pairs",
    cte("compared", res=_RES, ranked="SELECT task, residual, row_number() OVER (PARTITION BY task ORDER BY residual, ts) AS rank, count(*) OVER (PARTITION BY task) AS n FROM res",
        q="SELECT *, 0.01 + 0.98 * (rank - 1) / (n - 1) AS share FROM ranked", qt="SELECT *, sqrt(-2 * ln(least(share, 1 - share))) AS tt FROM q")
    + f"SELECT task, rank, {r('share', 'share')}, {r(_QUANTILE, 'theoretical')}, {r('residual', 'sample')} FROM qt",
)
def residual_qq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.qq_pairs(_res(spark, sf_dir), ["task"])


@catalog.query(
    "residual_histogram",
    cte("compared", res=_RES, s="SELECT task, min(residual) lo, max(residual) hi, avg(residual) m, stddev_pop(residual) sd, count(*) n, (max(residual)-min(residual))/50 AS w FROM res GROUP BY task",
        b="SELECT res.task, least(floor((residual-lo)/w), 49)::BIGINT AS bin, count(*) AS c FROM res JOIN s USING (task) GROUP BY ALL")
    + f"SELECT task, bin, {r('lo+bin*w', 'bin_start')}, {r('lo+bin*w+w', 'bin_end')}, coalesce(c, 0) AS n, "
    f"{r('exp(-pow((lo+bin*w+w/2-m)/sd,2)/2)/(sd*sqrt(2*pi()))*s.n*w', 'normal_count')} FROM (SELECT * FROM s, range(50) k(bin)) s LEFT JOIN b USING (task, bin)",
)
def residual_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.histogram(_res(spark, sf_dir), ["task"], "residual")


# --- quantiles of raw values --------------------------------------------------


@catalog.query(
    "value_quantiles",
    cte("raw") + f"SELECT task, count(value) AS n, {r('quantile_cont(value, 0.1)', 'p10')}, {r('median(value)', 'p50')}, {r('quantile_cont(value, 0.95)', 'p95')} FROM raw GROUP BY task",
)
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles over all raw records of a task, without one buffer per task."""
    return quantiles.exact_quantiles(base.records(spark, sf_dir), ["task"], "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95})


@catalog.query(
    "volume_quantiles_and_mode",
    cte("workload") + f"SELECT site, task, {r('quantile_cont(volume, 0.75)', 'p75')}, {r('median(volume)', 'median')}, {r('(SELECT v FROM (SELECT x.volume AS v, count(*) AS c FROM workload x WHERE x.site = w.site AND x.task = w.task GROUP BY 1) ORDER BY c DESC, v LIMIT 1)', 'mode')} FROM workload w GROUP BY site, task",
)
def volume_quantiles_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile, median and most frequent volume per series; a series is as long as the calendar."""
    w = base.workload(spark, sf_dir)
    return w.groupBy(*SERIES).agg(
        F.percentile("volume", 0.75).alias("p75"), F.median("volume").alias("median"),
        F.expr("mode(volume, true)").alias("mode"),
    )
