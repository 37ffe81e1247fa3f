"""Calendar and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, clock, numbers
from ..operators import features, hourly
from . import base
from .base import SERIES, Catalog, cte, d, i, r, t

catalog = Catalog()

# Published Easter Sundays, an independent check of the computed ones.
EASTER = "SELECT * FROM (VALUES " + ", ".join(
    f"(DATE '{x}')" for x in (
        "1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23",
        "2001-04-15", "2023-04-09", "2024-03-31",
    )
) + ") AS e(day)"
HOLIDAYS = (
    "SELECT day + x AS date, n AS name FROM easter, (VALUES (-2,'Good Friday'),(1,'Easter Monday'),(39,'Ascension Day'),"
    "(50,'Whit Monday'),(60,'Corpus Christi')) v(x, n) UNION ALL "
    "SELECT make_date(year(day), m, dd), n FROM easter, (VALUES (1,1,'New Year'),(1,6,'Epiphany'),(5,1,'Labour Day'),"
    "(8,15,'Assumption Day'),(10,3,'German Unity Day'),(11,1,'All Saints'),(12,25,'Christmas Day'),(12,26,'Second Christmas Day')) v(m, dd, n)"
)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.daily_orders(spark, sf_dir).withColumn("ts", F.col("date").cast("timestamp_ntz"))


@catalog.query(
    "time_features",
    cte("workload")
    + f"SELECT site, task, {t()}, hour(ts) AS hour, isodow(ts)-1 AS day_of_week, day(ts) AS day_of_month, weekofyear(ts) AS week_of_year, "
    "month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, (isodow(ts)>=6)::BIGINT AS is_weekend, (day(ts)=1)::BIGINT AS is_month_start, "
    "(last_day(ts)=ts::DATE)::BIGINT AS is_month_end, (hour(ts)>=8 AND hour(ts)<20)::BIGINT AS is_work_hours, "
    "(hour(ts) IN (10,11,14,15))::BIGINT AS is_peak_hours FROM workload",
)
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_time(base.workload(spark, sf_dir)).drop("volume")


@catalog.query(
    "cyclical_features",
    cte("daily")
    + f"SELECT {d()}, {r('sin(2*pi()*(isodow(date)-1)/7)', 'dow_sin')}, {r('cos(2*pi()*(isodow(date)-1)/7)', 'dow_cos')}, "
    f"{r('sin(2*pi()*month(date)/12)', 'month_sin')}, {r('cos(2*pi()*month(date)/12)', 'month_cos')}, "
    f"{r('sin(2*pi()*day(date)/31)', 'dom_sin')}, {r('cos(2*pi()*day(date)/31)', 'dom_cos')}, {r('0', 'hour_sin')}, {r('1', 'hour_cos')} FROM daily",
)
def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = features.add_cyclical(features.add_time(days(spark, sf_dir)))
    return both.select("date", *[f"{p}_{f}" for p in ("hour", "dow", "month", "dom") for f in ("sin", "cos")])


@catalog.query(
    "holiday_features",
    cte(
        "daily",
        easter=EASTER, holidays=HOLIDAYS,
        span="SELECT min(date) lo, max(date) hi FROM daily",
        held="SELECT date FROM holidays, span WHERE date BETWEEN lo AND hi",
        dist="SELECT x.date, (SELECT count(*) FROM held h WHERE h.date = x.date) > 0 AS is_holiday, "
        "(SELECT min(h.date) FROM held h WHERE h.date > x.date) - x.date AS nxt, x.date - (SELECT max(h.date) FROM held h WHERE h.date < x.date) AS prv FROM daily x",
        fin="SELECT date, is_holiday::BIGINT AS is_holiday, CASE WHEN is_holiday THEN 0 ELSE coalesce(nxt, 30) END AS days_to_holiday, "
        "CASE WHEN is_holiday THEN 0 ELSE coalesce(prv, 30) END AS days_from_holiday FROM dist",
    )
    + f"SELECT {d()}, is_holiday, {i('days_to_holiday', 'days_to_holiday')}, {i('days_from_holiday', 'days_from_holiday')}, "
    "(days_to_holiday=1)::BIGINT AS is_day_before_holiday, (days_from_holiday=1)::BIGINT AS is_day_after_holiday FROM fin",
)
def holiday_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six and a half years of order days beside their neighbouring holidays."""
    return features.add_holidays(days(spark, sf_dir)).drop("n", "total", "ts")


@catalog.query(
    "holiday_volume",
    cte("daily", easter=EASTER, holidays=HOLIDAYS)
    + f"SELECT {d('daily.date')}, name, {r('n', 'n')} FROM daily JOIN holidays USING (date)",
)
def holiday_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on each holiday of the generated calendar."""
    daily = base.daily_orders(spark, sf_dir)
    held = calendar.holidays_in(calendar.years_of(daily))
    return daily.join(F.broadcast(held), "date").select("date", "name", "n")


_RETAIL = (
    "SELECT first_friday + (21 + k)::INT AS date, ['Black Friday','Black Saturday','Cyber Monday Weekend','Cyber Monday'][k+1] AS name FROM "
    "(SELECT DISTINCT (make_date(year(date),11,1) + ((5 - isodow(make_date(year(date),11,1)) + 7) % 7)::INT) AS first_friday FROM daily), range(4) x(k) "
    "UNION ALL SELECT DISTINCT make_date(year(date), 12, dd::INT), 'Pre-Christmas Peak' FROM daily, range(15, 24) y(dd)"
)


@catalog.query(
    "retail_event_volume",
    cte("daily", events_r=_RETAIL) + f"SELECT {d('daily.date')}, name, {r('n', 'n')} FROM daily JOIN events_r ON events_r.date = daily.date",
)
def retail_event_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = base.daily_orders(spark, sf_dir)
    events = calendar.retail_events_in(calendar.years_of(daily))
    return daily.join(F.broadcast(events), "date").select("date", "name", "n")


@catalog.query(
    "event_flags",
    cte("daily", easter=EASTER, holidays=HOLIDAYS, events_r=_RETAIL, every="SELECT date, name FROM holidays UNION ALL SELECT date, name FROM events_r",
        flags="SELECT date, max((name='Black Friday')::INT) AS event_black_friday, max((name='Pre-Christmas Peak')::INT) AS event_pre_christmas_peak, "
        "max((name='Good Friday')::INT) AS event_good_friday FROM every GROUP BY date")
    + f"SELECT {d('daily.date')}, {i('coalesce(event_black_friday,0)', 'event_black_friday')}, {i('coalesce(event_pre_christmas_peak,0)', 'event_pre_christmas_peak')}, "
    f"{i('coalesce(event_good_friday,0)', 'event_good_friday')} FROM daily LEFT JOIN flags USING (date)",
)
def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays and retail events as 0/1 regressor columns."""
    named = ["Black Friday", "Pre-Christmas Peak", "Good Friday"]
    daily = days(spark, sf_dir)
    events = calendar.holiday_and_event_days(calendar.years_of(daily))
    return features.add_event_flags(daily, events, named).drop("n", "total", "ts")


_W = "OVER (PARTITION BY site, task ORDER BY ts)"


@catalog.query(
    "lag_features",
    cte("workload")
    + f"SELECT site, task, {t()}, " + ", ".join(r(f"lag(volume, {k}) {_W}", f"volume_lag_{k}h") for k in (1, 2, 3, 24, 48, 168)) + " FROM workload",
)
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_lags(base.workload(spark, sf_dir), SERIES, ["volume"]).drop("volume")


def _rolling_sql(part: str, sizes=(24, 48, 168)) -> str:
    out = []
    for n in sizes:
        w = f"OVER ({part} ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out += [r(f"avg(volume) {w}", f"volume_roll_mean_{n}h"), r(f"stddev_samp(volume) {w}", f"volume_roll_std_{n}h"),
                r(f"min(volume) {w}", f"volume_roll_min_{n}h"), r(f"max(volume) {w}", f"volume_roll_max_{n}h")]
    return ", ".join(out)


@catalog.query(
    "rolling_features",
    cte("workload_all") + f"SELECT task, {t()}, {_rolling_sql('PARTITION BY task')} FROM workload_all",
)
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_rolling(base.workload_all(spark, sf_dir), ["task"], ["volume"]).drop("volume")


def _same_time_sql(w: str) -> str:
    parts = [f"lag(volume, {168 * n}) {w}" for n in range(1, 5)]
    mean = f"list_avg([{', '.join(parts)}])"
    return ", ".join([
        r(f"lag(volume, 24) {w}", "volume_same_hour_yesterday"), r(parts[0], "volume_same_hour_last_week"),
        r(mean, "volume_same_hour_4week_avg"),
    ])


@catalog.query("same_time_features", cte("workload") + f"SELECT site, task, {t()}, {_same_time_sql(_W)} FROM workload")
def same_time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_same_time(base.workload(spark, sf_dir), SERIES, ["volume"]).drop("volume")


def _trend_sql(w: str) -> str:
    return ", ".join(
        [r(f"volume - lag(volume, {k}) {w}", f"volume_{n}_change") for n, k in (("hourly", 1), ("daily", 24), ("weekly", 168))]
        + [r(f"volume / nullif(lag(volume, {k}) {w}, 0) - 1", f"volume_{n}_pct_change") for n, k in (("hourly", 1), ("daily", 24))]
    )


@catalog.query("trend_features", cte("workload") + f"SELECT site, task, {t()}, {_trend_sql(_W)} FROM workload")
def trend_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_trend(base.workload(spark, sf_dir), SERIES, ["volume"]).drop("volume")


_WT = "OVER (PARTITION BY task ORDER BY ts)"
_HOLIDAY_HOURS = (
    "SELECT x.date, (SELECT count(*) FROM held h WHERE h.date = x.date) > 0 AS hol, "
    "(SELECT min(h.date) FROM held h WHERE h.date > x.date) - x.date AS nxt, x.date - (SELECT max(h.date) FROM held h WHERE h.date < x.date) AS prv "
    "FROM (SELECT DISTINCT ts::DATE AS date FROM workload_all) x"
)


@catalog.query(
    "feature_table",
    cte("workload_all", easter=EASTER, holidays=HOLIDAYS, held="SELECT date FROM holidays, bounds WHERE date BETWEEN lo::DATE AND hi::DATE",
        dist=_HOLIDAY_HOURS,
        hol="SELECT date, hol::BIGINT AS is_holiday, CASE WHEN hol THEN 0 ELSE coalesce(nxt,30) END AS days_to_holiday, CASE WHEN hol THEN 0 ELSE coalesce(prv,30) END AS days_from_holiday FROM dist")
    + f"SELECT task, {t()}, {r('volume', 'volume')}, hour(ts) AS hour, isodow(ts)-1 AS day_of_week, day(ts) AS day_of_month, weekofyear(ts) AS week_of_year, "
    "month(ts) AS month, quarter(ts) AS quarter, year(ts) AS year, (isodow(ts)>=6)::BIGINT AS is_weekend, (day(ts)=1)::BIGINT AS is_month_start, "
    "(last_day(ts)=ts::DATE)::BIGINT AS is_month_end, (hour(ts)>=8 AND hour(ts)<20)::BIGINT AS is_work_hours, (hour(ts) IN (10,11,14,15))::BIGINT AS is_peak_hours, "
    + ", ".join(
        r(f"{f}(2*pi()*({e})/{p})", f"{n}_{f}")
        for n, e, p in (("hour", "hour(ts)", 24), ("dow", "isodow(ts)-1", 7), ("month", "month(ts)", 12), ("dom", "day(ts)", 31))
        for f in ("sin", "cos")
    )
    + ", " + ", ".join(r(f"lag(volume, {k}) {_WT}", f"volume_lag_{k}h") for k in (1, 2, 3, 24, 48, 168))
    + f", {_rolling_sql('PARTITION BY task')}, {_same_time_sql(_WT)}, {_trend_sql(_WT)}, is_holiday, {i('days_to_holiday', 'days_to_holiday')}, "
    f"{i('days_from_holiday', 'days_from_holiday')}, (days_to_holiday=1)::BIGINT AS is_day_before_holiday, (days_from_holiday=1)::BIGINT AS is_day_after_holiday "
    "FROM workload_all JOIN hol ON hol.date = ts::DATE",
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of every task series in one pass."""
    bounds = hourly.time_bounds(base.records(spark, sf_dir))
    return features.build_features(base.workload_all(spark, sf_dir), ["task"], ["volume"], bounds=bounds).features


def _with_holes(df: DataFrame) -> DataFrame:
    """Volumes are unknown (NULL) where nothing was counted."""
    return df.withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))


_HOLES = "SELECT site, task, ts, nullif(volume, 0) AS volume FROM workload"


@catalog.query(
    "gap_fill",
    cte("workload", holes=_HOLES)
    + f"SELECT site, task, {t()}, " + r(
        "coalesce(last_value(volume IGNORE NULLS) OVER (PARTITION BY site, task ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "first_value(volume IGNORE NULLS) OVER (PARTITION BY site, task ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)", "volume")
    + " FROM holes",
)
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fill_gaps(_with_holes(base.workload(spark, sf_dir)), SERIES, ["volume"])


@catalog.query(
    "interpolation",
    cte("workload", holes=_HOLES, num=f"SELECT *, row_number() {_W} AS n FROM holes",
        marks="SELECT *, max(CASE WHEN volume IS NOT NULL THEN n END) OVER (PARTITION BY site, task ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, "
        "min(CASE WHEN volume IS NOT NULL THEN n END) OVER (PARTITION BY site, task ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM num")
    + f"SELECT m.site, m.task, {t('m.ts')}, " + r(
        "CASE WHEN m.volume IS NOT NULL THEN m.volume WHEN m.a IS NULL THEN NULL WHEN m.b IS NULL THEN x.volume "
        "ELSE x.volume + (y.volume - x.volume) * ((m.n - m.a)::DOUBLE / (m.b - m.a)) END", "volume")
    + " FROM marks m LEFT JOIN num x ON x.site = m.site AND x.task = m.task AND x.n = m.a LEFT JOIN num y ON y.site = m.site AND y.task = m.task AND y.n = m.b",
)
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.interpolate(_with_holes(base.workload(spark, sf_dir)), SERIES, "volume")


@catalog.query(
    "moving_averages",
    cte("workload_all")
    + f"SELECT task, {t()}, " + ", ".join(
        r(f"CASE WHEN count(volume) OVER (PARTITION BY task ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN "
          f"avg(volume) OVER (PARTITION BY task ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END", f"ma_{n}h")
        for n in (24, 168, 720))
    + " FROM workload_all",
)
def moving_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.moving_averages(base.workload_all(spark, sf_dir), ["task"], "volume").drop("volume")


_LAGGED = f"SELECT *, lag(volume, 1) {_W} AS volume_lag_1h, lag(volume, 168) {_W} AS volume_lag_168h FROM workload"


@catalog.query(
    "train_test_split",
    cte("workload", f=_LAGGED, ok="SELECT *, row_number() OVER (PARTITION BY site, task ORDER BY ts DESC) AS back FROM f WHERE volume_lag_1h IS NOT NULL AND volume_lag_168h IS NOT NULL")
    + f"SELECT site, task, CASE WHEN back <= 336 THEN 'test' ELSE 'train' END AS split, count(*) AS n, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')}, "
    f"{r('sum(volume_lag_168h)', 'lag_sum')} FROM ok GROUP BY ALL",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, span and lag sum of both parts; 14 days are held out."""
    lagged = features.add_lags(base.workload(spark, sf_dir), SERIES, ["volume"], (1, 168))
    split = features.train_test_split(lagged, SERIES)
    return split.groupBy("site", "task", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("volume_lag_168h").alias("lag_sum"),
    )


@catalog.query(
    "train_test_split_lenient",
    cte("workload", f=f"SELECT *, lag(volume, 1) {_W} AS volume_lag_1h, lag(volume, 400) {_W} AS volume_lag_400h FROM workload",
        med="SELECT site, task, median(volume_lag_1h) AS m1, median(volume_lag_400h) AS m2 FROM f GROUP BY ALL",
        ok="SELECT f.site, f.task, ts, coalesce(volume_lag_400h, m2) AS v, row_number() OVER (PARTITION BY f.site, f.task ORDER BY ts DESC) AS back FROM f JOIN med ON f.site = med.site AND f.task = med.task")
    + f"SELECT site, task, CASE WHEN back <= 336 THEN 'test' ELSE 'train' END AS split, count(*) AS n, {r('sum(v)', 'lag_sum')} FROM ok GROUP BY ALL",
)
def train_test_split_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Too few complete rows: the medians stand in for missing lags."""
    lagged = features.add_lags(base.workload(spark, sf_dir), SERIES, ["volume"], (1, 400))
    split = features.train_test_split(lagged, SERIES)
    return split.groupBy("site", "task", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("volume_lag_400h").alias("lag_sum"))


@catalog.query(
    "holdout_split",
    cte("workload")
    + "SELECT site, task, CASE WHEN ts > hi - INTERVAL 14 DAY THEN 'valid' ELSE 'train' END AS split, count(*) AS n, "
    f"{t('min(ts)', 'first_ts')}, {r('sum(volume)', 'volume')} FROM workload, bounds GROUP BY ALL",
)
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = features.holdout_split(base.workload(spark, sf_dir), SERIES)
    return split.groupBy("site", "task", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.sum("volume").alias("volume")
    )


@catalog.query(
    "history_with_future",
    cte("workload", fut="SELECT site, task, unnest(generate_series(hi + INTERVAL 1 HOUR, hi + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS ts, NULL::DOUBLE AS volume "
        "FROM (SELECT DISTINCT site, task FROM workload), bounds", joined="SELECT * FROM workload UNION ALL BY NAME SELECT * FROM fut")
    + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM joined",
)
def history_with_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.append_future(base.workload(spark, sf_dir), SERIES, 24)


@catalog.query(
    "calendar_labels",
    cte("daily")
    + f"SELECT {d()}, dayname(date) AS day_name, ['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag'][isodow(date)] AS german_day, "
    f"{d('date', 'day_start')}, {d('date_trunc(' + chr(39) + 'week' + chr(39) + ', date)', 'week_start')}, {d('date_trunc(' + chr(39) + 'month' + chr(39) + ', date)', 'month_start')}, "
    "isodow(date) < 6 AS is_weekday, isodow(date) > 5 AS is_weekend FROM daily",
)
def calendar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day names, period starts and weekday conditions of each order day."""
    return base.daily_orders(spark, sf_dir).select(
        "date", clock.day_name("date").alias("day_name"), clock.german_day_name("date").alias("german_day"),
        clock.period_start("date", "day").alias("day_start"), clock.period_start("date", "week").alias("week_start"),
        clock.period_start("date", "month").alias("month_start"), clock.is_weekday("date").alias("is_weekday"),
        (~clock.is_weekday("date")).alias("is_weekend"),
    )


@catalog.query(
    "shift_labels",
    cte("workload_all")
    + "SELECT CASE WHEN hour(ts) < 14 THEN '08:00-14:00' ELSE '14:00-20:00' END AS shift, task, count(*) AS n FROM workload_all WHERE hour(ts) >= 8 AND hour(ts) < 20 GROUP BY ALL",
)
def shift_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour shifts of the opening hours."""
    inside = base.workload_all(spark, sf_dir).filter(clock.is_working_hour("ts"))
    return inside.groupBy(clock.shift_label("ts", 6).alias("shift"), "task").agg(F.count(F.lit(1)).alias("n"))


@catalog.query(
    "display_forms",
    "SELECT o_orderkey, CASE WHEN abs(x) >= 1000000 THEN printf('%.1fM', x/1e6) WHEN abs(x) >= 1000 THEN printf('%.1fK', x/1e3) ELSE printf('%.0f', x) END AS compact, "
    "CASE WHEN s < 60 THEN s::BIGINT || ' second(s)' WHEN s < 3600 THEN (s // 60)::BIGINT || ' minute(s)' WHEN s < 86400 THEN (s // 3600)::BIGINT || ' hour(s)' "
    "ELSE (s // 86400)::BIGINT || ' day(s)' END AS duration FROM (SELECT o_orderkey, o_totalprice * 4.1 AS x, o_orderkey % 200000 AS s FROM orders)",
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact amounts and durations in words."""
    o = base.table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey",
        numbers.compact_number(F.col("o_totalprice") * F.lit(4.1)).alias("compact"),
        numbers.humanize_seconds(F.col("o_orderkey") % 200000).alias("duration"),
    )
