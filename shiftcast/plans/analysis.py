"""Decomposition and validation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decompose, features, hourly, rollups, validate
from . import base
from .base import SERIES, Catalog, cte, i, r, t

catalog = Catalog()


def _decomposed(period: int, model: str, source: str, keys: str = "task") -> dict[str, str]:
    """CTEs of the classical decomposition by joins and plain aggregates."""
    half = period // 2
    minus, over = ("-", "-") if model == "additive" else ("/", "/")
    ends = "0" if period % 2 else "(a.x + b.x)/2"
    return {
        "s0": f"SELECT {keys}, ts, volume AS x, row_number() OVER (PARTITION BY {keys} ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}",
        "ma": f"SELECT m.{keys} AS {keys}, m.i, any_value(m.n) AS n, (sum(w.x) - any_value({ends}))/{period} AS tr FROM s0 m JOIN s0 w ON w.{keys} = m.{keys} AND w.i BETWEEN m.i - {half} AND m.i + {half} "
        f"JOIN s0 a ON a.{keys} = m.{keys} AND a.i = m.i - {half} JOIN s0 b ON b.{keys} = m.{keys} AND b.i = m.i + {half} GROUP BY m.{keys}, m.i",
        "fit": f"SELECT {keys}, regr_slope(tr, i) FILTER (i < least({half}+{period}, n-1-{half})) AS hs, regr_intercept(tr, i) FILTER (i < least({half}+{period}, n-1-{half})) AS hc, "
        f"regr_slope(tr, i) FILTER (i >= greatest({half}, n-1-{half}-{period}) AND i < n-1-{half}) AS es, regr_intercept(tr, i) FILTER (i >= greatest({half}, n-1-{half}-{period}) AND i < n-1-{half}) AS ec FROM ma GROUP BY {keys}",
        "tr": f"SELECT s0.*, CASE WHEN ma.tr IS NOT NULL THEN ma.tr WHEN s0.i < {half} THEN hs*s0.i+hc ELSE es*s0.i+ec END AS trend FROM s0 LEFT JOIN ma ON ma.{keys} = s0.{keys} AND ma.i = s0.i JOIN fit ON fit.{keys} = s0.{keys}",
        "pm": f"SELECT {keys}, i % {period} AS ph, avg(x {minus} trend) AS p FROM tr GROUP BY ALL",
        "cm": f"SELECT {keys}, avg(p) AS c FROM pm GROUP BY {keys}",
        "parts": f"SELECT tr.{keys} AS {keys}, ts, x AS observed, trend, p {minus} c AS seasonal, (x {minus} trend) {over} (p {minus} c) AS residual FROM tr "
        f"JOIN pm ON pm.{keys} = tr.{keys} AND pm.ph = tr.i % {period} JOIN cm ON cm.{keys} = tr.{keys}",
    }


_PARTS = f"SELECT task, {t()}, {r('observed', 'observed')}, {r('trend', 'trend')}, {r('seasonal', 'seasonal')}, {r('residual', 'residual')} FROM parts"


@catalog.query("decomposition", cte("workload_all", **_decomposed(24, "additive", "workload_all")) + _PARTS)
def decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily pattern of every task series."""
    return decompose.decompose(base.workload_all(spark, sf_dir), ["task"], "volume", 24)


_DAY_SERIES = {
    "dser": "SELECT 'orders' AS task, date::TIMESTAMP AS ts, coalesce(n, 0) + 1 AS volume FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM daily) LEFT JOIN daily USING (date)",
}


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = base.daily_orders(spark, sf_dir).select(F.lit("orders").alias("task"), F.col("date").cast("timestamp_ntz").alias("ts"), "n")
    dense = rollups.daily_totals(days, ["task"], ["n"])
    return dense.select("task", F.col("date").cast("timestamp_ntz").alias("ts"), (F.col("n") + 1).alias("volume"))


@catalog.query("decomposition_multiplicative", cte("daily", **_DAY_SERIES, **_decomposed(7, "multiplicative", "dser")) + _PARTS)
def decomposition_multiplicative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly pattern of the orders per day (plus one), an odd period."""
    return decompose.decompose(_order_days(spark, sf_dir), ["task"], "volume", 7, "multiplicative")


@catalog.query(
    "decomposition_summary",
    cte("workload_all", **_decomposed(24, "additive", "workload_all"),
        g="SELECT task, arg_min(trend, ts) AS a, arg_max(trend, ts) AS b, var_samp(residual) AS vr, var_samp(seasonal) AS vs, var_samp(observed-trend) AS vd, max(seasonal) AS mx, min(seasonal) AS mn, "
        "avg(residual) AS rm, stddev_samp(residual) AS rs, max(residual) AS rx, min(residual) AS rn FROM parts GROUP BY task")
    + f"SELECT task, {r('a', 'start_value')}, {r('b', 'end_value')}, {r('(b-a)/a*100', 'change_percent')}, CASE WHEN (b-a)/a > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, "
    f"{r('greatest(0, 1-vr/(vs+vr))', 'seasonal_strength')}, {r('greatest(0, 1-vr/vd)', 'trend_strength')}, {r('mx', 'max_effect')}, {r('mn', 'min_effect')}, {r('mx-mn', 'seasonal_range')}, "
    f"{r('rm', 'residual_mean')}, {r('rs', 'residual_std')}, {r('rx', 'residual_max')}, {r('rn', 'residual_min')} FROM g",
)
def decomposition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.summary(decompose.decompose(base.workload_all(spark, sf_dir), ["task"]), ["task"])


@catalog.query(
    "seasonal_profile",
    cte("workload_all", **_decomposed(24, "additive", "workload_all"))
    + f"SELECT task, {i('hour(ts)', 'hour')}, {r('avg(seasonal)', 'seasonal_mean')}, {r('stddev_samp(seasonal)', 'seasonal_std')}, {r('avg(observed)', 'observed_mean')}, {r('stddev_samp(observed)', 'observed_std')} FROM parts GROUP BY task, hour(ts)",
)
def seasonal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.seasonal_profile(decompose.decompose(base.workload_all(spark, sf_dir), ["task"]), ["task"])


@catalog.query(
    "trend_first_last",
    cte("workload_all", **_decomposed(24, "additive", "workload_all"))
    + f"SELECT task, {r('arg_min(trend, ts)', 'first_value')}, {r('arg_max(trend, ts)', 'last_value')}, {r('(arg_max(trend, ts)-arg_min(trend, ts))/arg_min(trend, ts)*100', 'change_pct')} FROM parts GROUP BY task",
)
def trend_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.first_last_change(decompose.decompose(base.workload_all(spark, sf_dir), ["task"]), ["task"], "trend")


_ACF = {
    "c": "SELECT task, row_number() OVER (PARTITION BY task ORDER BY ts) AS i, volume - avg(volume) OVER (PARTITION BY task) AS x FROM workload_all",
    "v": "SELECT task, sum(x*x) AS s0, count(*) AS n FROM c GROUP BY task",
    "k": "SELECT a.task, b.i - a.i AS lag, sum(a.x*b.x) AS s FROM c a JOIN c b ON a.task = b.task AND b.i - a.i BETWEEN 0 AND 48 GROUP BY ALL",
}


@catalog.query("autocorrelation", cte("workload_all", **_ACF) + f"SELECT k.task, {i('lag', 'lag')}, {r('s/s0', 'acf')}, {r('1.96/sqrt(n)', 'band')} FROM k JOIN v ON v.task = k.task")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.acf(base.workload_all(spark, sf_dir), ["task"])


_LAGS = {
    "c": "SELECT task, volume - avg(volume) OVER (PARTITION BY task) AS x, row_number() OVER (PARTITION BY task ORDER BY ts) AS i, count(*) OVER (PARTITION BY task) AS n FROM workload_all",
    "lagged": "SELECT a.task, b.i - a.i AS k, any_value(a.n) AS n, sum(a.x * b.x) / (any_value(a.n) - (b.i - a.i)) AS r FROM c a JOIN c b ON a.task = b.task AND b.i BETWEEN a.i AND a.i + 48 GROUP BY 1, 2",
    "listed": "SELECT task, any_value(n) AS n, list(r ORDER BY k) AS r FROM lagged GROUP BY task",
    "p": "SELECT task, n, r, 0 AS k, []::DOUBLE[] AS phi, r[1] AS v, 1.0::DOUBLE AS a FROM listed UNION ALL "
    "SELECT task, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - a2 * phi[k + 1 - j]), a2), v * (1 - a2 * a2), a2 FROM "
    "(SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / v AS a2 FROM p WHERE k < 48)",
}


@catalog.query(
    "partial_autocorrelation",
    cte("workload_all", **_LAGS).replace("WITH ", "WITH RECURSIVE ", 1) + f"SELECT task, k AS lag, {r('a', 'pacf')}, {r('1.96 / sqrt(n)', 'band')} FROM p",
)
def partial_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decompose.pacf(base.workload_all(spark, sf_dir), ["task"])


# The regressions in SQL: one matrix of products per sample of rows, from which the sweep operator takes
# one variable after the other (1 constant, 2 level, then lags; the last one is explained).
_SWEPT = (
    "list_transform(range(1, w + 1), lambda i: list_transform(range(1, w + 1), lambda j: CASE WHEN i = k AND j = k THEN -1 / m[k][k] "
    "WHEN i = k OR j = k THEN m[i][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"
)


def _products(rows: str, on: str, width: str) -> str:
    """The matrix of summed products of ``v`` over rows ``on`` a condition, per task."""
    return (
        f"SELECT task, w, n, list(line ORDER BY i) AS m FROM (SELECT task, i, any_value(w) AS w, any_value(n) AS n, list(x ORDER BY j) AS line FROM "
        f"(SELECT task, i, j, any_value(w) AS w, count(*) AS n, sum(v[i] * v[j]) AS x FROM (SELECT task, t, {width} AS w, v, unnest(range(1, {width} + 1)) AS i FROM {rows} WHERE {on}) a, "
        f"LATERAL (SELECT unnest(range(1, w + 1)) AS j) GROUP BY task, i, j) GROUP BY task, i) GROUP BY task, w, n"
    )


_ADF = {
    "x": "SELECT site || ':' || task AS task, row_number() OVER (PARTITION BY site, task ORDER BY ts) - 1 AS t, volume AS x, count(*) OVER (PARTITION BY site, task) AS size FROM workload",
    "series": "SELECT task, size, list(x ORDER BY t) AS xs, least(ceil(12 * pow(size / 100, 0.25)), size // 2 - 2)::BIGINT AS lim FROM x GROUP BY ALL HAVING min(x) < max(x)",
    "v": "SELECT task, size, lim, t, list_concat(list_concat([1.0, xs[t + 1]], list_transform(range(1, lim + 1), lambda d: coalesce(xs[t - d + 2] - xs[t - d + 1], 0))), [xs[t + 2] - xs[t + 1]]) AS v "
    "FROM (SELECT *, unnest(range(0, size - 1)) AS t FROM series)",
    "g": _products("v", "t >= lim", "lim + 3"),
    "s": f"SELECT task, n, w, m, 1 AS k FROM g UNION ALL SELECT task, n, w, {_SWEPT}, k + 1 FROM s WHERE k < w",
    "aic": "SELECT task, k - 3 AS lags, n * (ln(2 * pi()) + ln(m[w][w] / n) + 1) + 2 * (k - 1) AS aic FROM s WHERE k >= 3",
    "best": "SELECT task, arg_min(lags, aic) AS lags FROM aic GROUP BY task",
    "v2": "SELECT v.task, size, t, best.lags, list_append(v[1:best.lags + 2], v[lim + 3]) AS v FROM v JOIN best USING (task)",
    "g2": _products("v2", "t >= lags", "lags + 3"),
    "s2": f"SELECT task, n, w, m, 1 AS k FROM g2 UNION ALL SELECT task, n, w, {_SWEPT}, k + 1 FROM s2 WHERE k < w",
    "found": "SELECT task, n, w - 3 AS n_lags, m[w][2] / sqrt(-m[2][2] * m[w][w] / (n - w + 1)) AS stat FROM s2 WHERE k = w",
}


def _poly_sql(coefs) -> str:
    return " + ".join(f"({c!r}) * pow(stat, {k})" for k, c in enumerate(coefs))


_ADF |= {
    "z": f"SELECT *, CASE WHEN stat <= {decompose.P_STAR} THEN {_poly_sql(decompose.P_SMALL)} ELSE {_poly_sql(decompose.P_LARGE)} END AS z FROM found",
    # The normal distribution from the middle to z by Simpson's rule.
    "p": f"SELECT task, n, n_lags, stat, CASE WHEN stat > {decompose.P_MAX} THEN 1.0 WHEN stat < {decompose.P_MIN} THEN 0.0 ELSE 0.5 + z / 6000 / sqrt(2 * pi()) * "
    "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000, 2) / 2))) END AS p FROM z",
}


def _critical_sql(level: str) -> str:
    return " + ".join(f"({b!r}) / pow(p.n, {k})" for k, b in enumerate(decompose.CRITICAL[level]))


@catalog.query(
    "stationarity",
    cte("workload", **_ADF).replace("WITH ", "WITH RECURSIVE ", 1)
    + f"SELECT split_part(p.task, ':', 1)::BIGINT AS site, split_part(p.task, ':', 2) AS task, {r('stat', 'statistic')}, {r('p', 'p_value')}, n_lags, size AS n, "
    f"{r(_critical_sql('1%'), 'critical_1')}, {r(_critical_sql('5%'), 'critical_5')}, {r(_critical_sql('10%'), 'critical_10')}, p < 0.05 AS is_stationary "
    "FROM p JOIN series USING (task)",
)
def stationarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Augmented Dickey–Fuller test of every site and task."""
    return decompose.stationarity(base.workload(spark, sf_dir), SERIES)


# --- validation ---------------------------------------------------------------

AS_OF = "2024-01-20 00:00:00"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide hours that occur in the data, spoiled by rule: unknown, negative and huge values, repeated hours."""
    w = hourly.wide_hourly(base.records(spark, sf_dir), [])
    spoiled = w.select(
        "ts",
        F.when(F.hour("ts") % 6 > 0, F.col("call_volume")).alias("call_volume"),
        F.when(F.dayofmonth("ts") == 3, -F.col("email_count")).otherwise(F.col("email_count") * F.when(F.hour("ts") == 5, 9000).otherwise(1)).alias("email_count"),
        F.when(F.hour("ts") < 12, F.lit(0.0)).otherwise(F.col("outbound_ook")).alias("outbound_ook"),
    ).filter("NOT hour(ts) IN (2, 3)").filter("NOT (dayofmonth(ts) = 9 AND hour(ts) BETWEEN 8 AND 18)")
    return spoiled.unionByName(spoiled.filter("hour(ts) = 7"))


_DIRTY = {
    "w0": "SELECT ts, coalesce(sum(volume) FILTER (task='calls'),0) AS c, coalesce(sum(volume) FILTER (task='emails'),0) AS e, coalesce(sum(volume) FILTER (task='outbound_ook'),0) AS o FROM hourly_all GROUP BY ts",
    "w1": "SELECT ts, CASE WHEN hour(ts) % 6 > 0 THEN c END AS call_volume, CASE WHEN day(ts) = 3 THEN -e ELSE e*(CASE WHEN hour(ts)=5 THEN 9000 ELSE 1 END) END AS email_count, CASE WHEN hour(ts) < 12 THEN 0.0 ELSE o END AS outbound_ook "
    "FROM w0 WHERE hour(ts) NOT IN (2,3) AND NOT (day(ts)=9 AND hour(ts) BETWEEN 8 AND 18)",
    "dirty": "SELECT * FROM w1 UNION ALL SELECT * FROM w1 WHERE hour(ts) = 7",
    "df": "SELECT date_diff('second', lag(ts) OVER (ORDER BY ts), ts) AS s FROM dirty",
    "dm": "SELECT median(s) AS md, max(s) AS mx, (SELECT s FROM (SELECT s, count(*) AS c FROM df WHERE s IS NOT NULL GROUP BY s) ORDER BY c DESC, s LIMIT 1) AS mo FROM df",
    "ag": "SELECT count(*) AS n, date_diff('day', min(ts), max(ts)) AS days FROM dirty",
    "nulls": "SELECT 'CALLS' AS col, count(*) FILTER (call_volume IS NULL) AS nn, count(*) FILTER (call_volume < 0) AS neg, count(*) FILTER (call_volume > 10000) AS hi, count(*) FILTER (call_volume = 0) AS z FROM dirty "
    "UNION ALL SELECT 'EMAILS', count(*) FILTER (email_count IS NULL), count(*) FILTER (email_count < 0), count(*) FILTER (email_count > 5000), count(*) FILTER (email_count = 0) FROM dirty "
    "UNION ALL SELECT 'OUTBOUND_OOK', count(*) FILTER (outbound_ook IS NULL), count(*) FILTER (outbound_ook < 0), count(*) FILTER (outbound_ook > 2000), count(*) FILTER (outbound_ook = 0) FROM dirty",
    "issues": f"SELECT 'FUTURE_TIMESTAMPS' AS code, 'warning' AS severity, count(*) AS n FROM dirty WHERE ts > TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY UNION ALL "
    f"SELECT 'OLD_TIMESTAMPS', 'info', count(*) FROM dirty WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 1825 DAY UNION ALL "
    "SELECT 'DATA_GAPS', 'warning', count(*) FROM df, dm WHERE s > 3*md UNION ALL "
    "SELECT 'DUPLICATE_TIMESTAMPS', 'warning', count(*) - count(DISTINCT ts) FROM dirty UNION ALL "
    "SELECT 'TIMESTAMP_GRANULARITY', 'info', 1 UNION ALL "
    "SELECT 'INSUFFICIENT_HISTORY', 'warning', days FROM ag WHERE days < 30 UNION ALL SELECT 'LIMITED_HISTORY', 'info', days FROM ag WHERE days BETWEEN 30 AND 89 UNION ALL "
    "SELECT 'MISSING_HOURS', 'info', 24 - count(DISTINCT hour(ts)) FROM dirty UNION ALL "
    "SELECT 'NULL_VALUES_' || col, CASE WHEN nn*100.0/n > 50 THEN 'error' WHEN nn*100.0/n > 10 THEN 'warning' ELSE 'info' END, nn FROM nulls, ag UNION ALL "
    "SELECT 'NEGATIVE_VALUES_' || col, 'error', neg FROM nulls UNION ALL SELECT 'HIGH_VALUES_' || col, 'warning', hi FROM nulls UNION ALL "
    "SELECT 'HIGH_ZERO_RATIO_' || col, 'info', z FROM nulls, ag WHERE z*100.0/n > 30 UNION ALL "
    "SELECT 'MISSING_REQUIRED_COLUMNS', 'warning', 2",
}


# What the findings say beside their number: as numbers and as text.
_MEASURES, _WORDS = ("median_interval", "largest_gap", "pct", "max_expected", "max_found"), ("granularity", "hours", "missing", "data_type")
_DETAIL_COLUMNS = ", ".join([*[r(c, c) for c in _MEASURES], *_WORDS])
_NO_DETAILS = ", ".join([*[f"NULL::DOUBLE AS {c}" for c in _MEASURES], *[f"NULL::VARCHAR AS {c}" for c in _WORDS]])


def _with_details(issues: DataFrame, *keys: str) -> DataFrame:
    said = F.col("details")
    return issues.select(
        *keys, "code", "severity", "n", *[said[c].cast("double").alias(c) for c in _MEASURES], *[said[c].alias(c) for c in _WORDS]
    )


_NOTES = (
    f"SELECT NULL::VARCHAR AS code, {_NO_DETAILS} WHERE false UNION ALL BY NAME SELECT 'DATA_GAPS' AS code, md AS median_interval, mx AS largest_gap FROM dm "
    "UNION ALL BY NAME SELECT 'TIMESTAMP_GRANULARITY' AS code, CASE WHEN mo < 60 THEN mo || ' second(s)' WHEN mo < 3600 THEN mo // 60 || ' minute(s)' "
    "WHEN mo < 86400 THEN mo // 3600 || ' hour(s)' ELSE mo // 86400 || ' day(s)' END AS granularity FROM dm "
    "UNION ALL BY NAME SELECT 'MISSING_HOURS' AS code, string_agg(h::VARCHAR, ',' ORDER BY h) AS hours FROM range(24) k(h) WHERE h NOT IN (SELECT hour(ts) FROM dirty) "
    "UNION ALL BY NAME SELECT 'NULL_VALUES_' || col AS code, round(nn * 100.0::DOUBLE / n, 1) AS pct FROM nulls, ag "
    "UNION ALL BY NAME SELECT 'HIGH_ZERO_RATIO_' || col AS code, round(z * 100.0::DOUBLE / n, 1) AS pct FROM nulls, ag "
    "UNION ALL BY NAME SELECT 'HIGH_VALUES_CALLS' AS code, 10000 AS max_expected, max(call_volume) AS max_found FROM dirty "
    "UNION ALL BY NAME SELECT 'HIGH_VALUES_EMAILS' AS code, 5000 AS max_expected, max(email_count) AS max_found FROM dirty "
    "UNION ALL BY NAME SELECT 'HIGH_VALUES_OUTBOUND_OOK' AS code, 2000 AS max_expected, max(outbound_ook) AS max_found FROM dirty "
    "UNION ALL BY NAME SELECT 'MISSING_REQUIRED_COLUMNS' AS code, 'outbound_omk,outbound_nb' AS missing, 'outbound' AS data_type"
)


@catalog.query(
    "validation_findings",
    cte("hourly_all", **_DIRTY, notes=_NOTES)
    + f"SELECT code, severity, {i('n', 'n')}, {_DETAIL_COLUMNS} FROM issues LEFT JOIN notes USING (code) WHERE n > 0",
)
def validation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule over a spoiled workload table, with all that the findings say."""
    return _with_details(validate.validate(_dirty(spark, sf_dir), AS_OF, data_type="outbound"))


ORDERS_AS_OF = "2002-01-01 00:00:00"
_STRUCTURE = ("DATA_EMPTY", "MISSING_TIMESTAMP", "MISSING_VALUE_COLUMNS", "MISSING_REQUIRED_COLUMNS", "INVALID_TIMESTAMP_FORMAT", "OLD_TIMESTAMPS")


@catalog.query(
    "validation_structure",
    f"WITH found AS (SELECT NULL::VARCHAR AS input, NULL::VARCHAR AS code, NULL::VARCHAR AS severity, NULL::BIGINT AS n, {_NO_DETAILS} WHERE false "
    "UNION ALL BY NAME SELECT 'unreadable' AS input, 'INVALID_TIMESTAMP_FORMAT' AS code, 'error' AS severity, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0 "
    "UNION ALL BY NAME SELECT 'unreadable' AS input, 'MISSING_REQUIRED_COLUMNS' AS code, 'warning' AS severity, 1 AS n, 'emails' AS missing, 'emails' AS data_type "
    "UNION ALL BY NAME SELECT 'unreadable' AS input, 'OLD_TIMESTAMPS' AS code, 'info' AS severity, count(*) AS n FROM orders "
    f"WHERE o_orderkey % 7 <> 0 AND o_orderdate < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 1825 DAY "
    "UNION ALL BY NAME SELECT 'no_time' AS input, 'MISSING_TIMESTAMP' AS code, 'error' AS severity, 1 AS n "
    "UNION ALL BY NAME SELECT 'no_time' AS input, 'MISSING_REQUIRED_COLUMNS' AS code, 'warning' AS severity, 1 AS n, 'timestamp' AS missing, 'calls' AS data_type "
    "UNION ALL BY NAME SELECT 'no_values' AS input, 'MISSING_VALUE_COLUMNS' AS code, 'error' AS severity, 1 AS n "
    f"UNION ALL BY NAME SELECT 'no_values' AS input, 'OLD_TIMESTAMPS' AS code, 'info' AS severity, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 1825 DAY "
    "UNION ALL BY NAME SELECT 'empty' AS input, 'DATA_EMPTY' AS code, 'error' AS severity, 0 AS n) "
    f"SELECT input, code, severity, n, {_DETAIL_COLUMNS} FROM found WHERE n > 0 OR code = 'DATA_EMPTY'",
)
def validation_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on missing columns, empty tables, unreadable and old times, over the orders spoiled for each."""
    o = base.table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    calls, at = F.col("o_custkey").alias("calls"), F.col("o_orderdate").alias("ts")
    inputs = {
        "unreadable": (o.select(text.alias("ts"), calls), "emails"),
        "no_time": (o.select(calls), "calls"),
        "no_values": (o.select(at), None),
        "empty": (o.filter("o_orderkey < 0").select(at, calls), None),
    }
    found = [
        _with_details(validate.validate(df, ORDERS_AS_OF, data_type=kind).withColumn("input", F.lit(name)), "input")
        for name, (df, kind) in inputs.items()
    ]
    return reduce(DataFrame.unionByName, found).filter(F.col("code").isin(*_STRUCTURE))


@catalog.query(
    "validation_severities",
    cte("hourly_all", **_DIRTY)
    + "SELECT count(*) FILTER (severity='error') AS error_count, count(*) FILTER (severity='warning') AS warning_count, count(*) FILTER (severity='info') AS info_count, count(*) FILTER (severity='error') = 0 AS is_valid FROM issues WHERE n > 0",
)
def validation_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.severity_counts(validate.validate(_dirty(spark, sf_dir), AS_OF, data_type="outbound"))


@catalog.query(
    "validation_statistics",
    cte("hourly_all", **_DIRTY)
    + " UNION ALL ".join(
        f"SELECT '{role}' AS column, {r(f'avg({c})', 'mean')}, {r(f'median({c})', 'median')}, {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')} FROM dirty"
        for role, c in (("calls", "call_volume"), ("emails", "email_count"), ("outbound_ook", "outbound_ook"))
    ),
)
def validation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.statistics(_dirty(spark, sf_dir))


@catalog.query(
    "record_intervals",
    cte("raw", g="SELECT task, date_diff('microsecond', lag(ts) OVER (PARTITION BY task ORDER BY ts), ts) AS s FROM raw",
        m="SELECT task, median(s) AS md FROM g GROUP BY task", mo="SELECT task, s FROM (SELECT task, s, row_number() OVER (PARTITION BY task ORDER BY c DESC, s) AS k FROM (SELECT task, s, count(*) AS c FROM g WHERE s IS NOT NULL GROUP BY ALL)) WHERE k = 1")
    + f"SELECT g.task, {r('any_value(md)/1e6', 'median_seconds')}, {r('max(g.s)/1e6', 'largest_seconds')}, {r('any_value(mo.s)/1e6', 'granularity_seconds')}, count(*) FILTER (g.s > 3*md) AS gaps, "
    "count(*) FILTER (g.s = 0) AS duplicates FROM g JOIN m ON m.task = g.task JOIN mo ON mo.task = g.task GROUP BY g.task",
)
def record_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between neighbouring raw records per task, sorted in day slices."""
    return validate.intervals(base.records(spark, sf_dir), ["task"])


@catalog.query(
    "offending_rows",
    cte("hourly_all", **_DIRTY, broken="SELECT 'NULL' AS code, ts, email_count FROM dirty WHERE call_volume IS NULL UNION ALL SELECT 'NEGATIVE', ts, email_count FROM dirty WHERE email_count < 0 UNION ALL SELECT 'HIGH', ts, email_count FROM dirty WHERE email_count > 5000")
    + f"SELECT code, {t()}, {r('email_count', 'email_count')} FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts, email_count) AS k FROM broken) WHERE k <= 10",
)
def offending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows that break each rule."""
    rules = {"NULL": F.col("call_volume").isNull(), "NEGATIVE": F.col("email_count") < 0, "HIGH": F.col("email_count") > 5000}
    return validate.offending_rows(_dirty(spark, sf_dir), rules, ["ts", "email_count"]).select("code", "ts", "email_count")


@catalog.query(
    "duplicate_rows",
    "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and later orders of a customer on one day."""
    o = base.table(spark, sf_dir, "orders")
    return validate.duplicates(o, ["o_custkey", "o_orderdate"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderdate")


@catalog.query(
    "unseen_hours",
    cte("hourly", hh="SELECT site, task, h FROM (SELECT DISTINCT site, task FROM hourly), range(24) x(h)")
    + f"SELECT site, task, {i('h', 'hour')} FROM hh ANTI JOIN (SELECT DISTINCT site, task, hour(ts) AS h FROM hourly) s USING (site, task, h)",
)
def unseen_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the day in which a series never had a record."""
    return features.unseen_hours(base.records(spark, sf_dir), SERIES)
