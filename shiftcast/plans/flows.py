"""File, upload and streaming queries."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hourly
from ..session import new_work_path, persist_to_shared
from ..sources import files, loaders, stores, uploads
from ..streaming import live, lockout, sessions
from . import base, staffing
from .base import SERIES, Catalog, cte, d, i, r, t

catalog = Catalog()

# --- files ----------------------------------------------------------------------


def _drop_files(spark: SparkSession, sf_dir: str) -> str:
    """The records as a drop folder of raw files: two layouts of call files, one of
    e-mail counts, one of outbound rows."""
    path = new_work_path(spark, "drop")
    first = F.dayofmonth("ts") <= 15
    calls = base.records(spark, sf_dir, ["calls"])
    stores.write_csv(
        calls.filter(first).select(F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("Datum"), F.col("site").alias("Queue ")), f"{path}/calls_a.csv", ";"
    )
    stores.write_csv(
        calls.filter(~first).select(F.lit(1).alias("Calls"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp")), f"{path}/calls_b.csv"
    )
    mails = base.records(spark, sf_dir, ["emails"]).groupBy(F.date_format("ts", "dd/MM/yyyy HH:00").alias("date")).agg(F.count(F.lit(1)).alias("Email Count"))
    stores.write_csv(mails, f"{path}/email_counts.csv", ";")
    outbound = base.records(spark, sf_dir, base.OUTBOUND).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit(" "), F.substring("task", 10, 9)).alias("Typ"), F.lit(2).alias("Anzahl")
    )
    stores.write_csv(outbound, f"{path}/outbound.csv")
    return path


_LOADED = "SELECT task, ts, CASE WHEN task LIKE 'outbound_%' THEN 2*volume ELSE volume END AS volume FROM hourly_all"


@catalog.query("load_call_files", cte("hourly_all", ld=_LOADED) + f"SELECT task, {t()}, {r('volume', 'volume')} FROM ld WHERE task = 'calls'")
def load_call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with different headers, separators and time formats, counted per hour."""
    return loaders.load_calls(spark, _drop_files(spark, sf_dir))


@catalog.query("load_all_files", cte("hourly_all", ld=_LOADED) + f"SELECT task, {t()}, {r('volume', 'volume')} FROM ld")
def load_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaders.load_all(spark, _drop_files(spark, sf_dir))


@catalog.query(
    "file_rows",
    cte("raw") + "SELECT count(*) AS rows, sum(19 + 1 + length(task) - 9 + 1 + 1 + 1)::BIGINT AS data_bytes, 0 AS wrong_names, 0 AS wrong_times FROM raw WHERE task LIKE 'outbound_%'",
)
def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of one folder's files without their headers, and how many names and times of
    change cannot be right; the number of part files is Spark's choice."""
    before = datetime.now(timezone.utc) - timedelta(minutes=1)
    inventory = files.file_inventory(spark, f"{_drop_files(spark, sf_dir)}/outbound.csv")
    header = len("timestamp,Typ,Anzahl\n")
    return inventory.agg(
        F.sum("rows").alias("rows"), F.sum(F.col("size_bytes") - header).alias("data_bytes"),
        F.count_if(~F.col("filename").rlike(r"^part-\d+-.*\.csv$")).alias("wrong_names"),
        F.count_if(~F.col("modified_at").between(F.lit(before), F.current_timestamp())).alias("wrong_times"),
    )


@catalog.query(
    "sorted_sink",
    cte("hourly") + f"SELECT site, task, {t()}, {r('volume', 'volume')}, row_number() OVER (ORDER BY ts, site, task) AS place FROM hourly",
)
def sorted_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in total order of time: where each row lies in the files, counted from the first."""
    path = new_work_path(spark, "sorted")
    stores.write_sorted(hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES), path, ["ts", "site", "task"])
    return stores.read_placed(spark, path).select("site", "task", "ts", "volume", "place")


@catalog.query(
    "hourly_store_range",
    cte("hourly") + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM hourly WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-11 23:00:00'",
)
def hourly_store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days read back from the hourly table partitioned by month."""
    path = new_work_path(spark, "hourly")
    stores.write_hourly(hourly.aggregate_hourly(base.records(spark, sf_dir), SERIES), path)
    return stores.read_hourly(spark, path, "2024-01-10 00:00:00", "2024-01-11 23:00:00")


@catalog.query(
    "parsed_times",
    f"SELECT o_orderkey, {t('CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate END', 'ts')} FROM orders",
)
def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in three layouts and one that cannot be read, told apart row by row."""
    o, at = base.table(spark, sf_dir, "orders"), F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(at, "dd.MM.yyyy HH:mm"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(at, "dd/MM/yyyy HH:mm:ss"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(at, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(at, "'week' D yyyy"))
    )
    return files.parse_timestamp(o.select("o_orderkey", text.alias("ts")), "ts")


@catalog.query(
    "lead_import",
    f"SELECT {d('o_orderdate', 'date')}, {i('floor(o_totalprice)', 'leads')} FROM orders WHERE o_orderkey % 9 > 1",
)
def lead_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-first dates and numbers; rows that lack either are dropped."""
    o = base.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 9
    text = F.when(k == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    number = F.when(k == 1, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string"))
    return files.read_leads(o.select(text.alias("Datum"), number.alias("Leads")))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV payload per month of orders, every third with semicolons, some broken."""
    days = base.daily_orders(spark, sf_dir)
    sep = F.when(F.month("date") % 3 == 0, ";").otherwise(",")
    line = F.concat(F.date_format("date", "yyyy-MM-dd"), sep, F.col("n").cast("bigint"))
    months = days.groupBy(F.date_format("date", "yyyy-MM").alias("month"), sep.alias("sep")).agg(
        F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("body")  # at most 31 lines
    )
    text = F.concat(F.lit("Date"), F.col("sep"), F.lit(" Calls"), F.lit("\r\n"), F.col("body"), F.lit("\r\n"))
    content = F.when(F.col("month").endswith("-05"), F.lit("%%%")).otherwise(F.base64(F.encode(text, "utf-8")))
    name = F.concat(F.col("month"), F.when(F.col("month").endswith("-07"), ".pdf").otherwise(".csv"))
    return months.select(name.alias("name"), F.lit("calls").alias("type"), content.alias("content"))


@catalog.query(
    "upload_summary",
    cte("daily", m="SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM daily GROUP BY 1")
    + "SELECT month || CASE WHEN month LIKE '%-07' THEN '.pdf' ELSE '.csv' END AS name, 'calls' AS type, month NOT LIKE '%-05' AND month NOT LIKE '%-07' AS success, "
    "CASE WHEN month LIKE '%-05' THEN 'NOT_BASE64' WHEN month LIKE '%-07' THEN 'UNSUPPORTED_FORMAT' END AS error, "
    "CASE WHEN month NOT LIKE '%-05' AND month NOT LIKE '%-07' THEN n END AS rows, CASE WHEN month NOT LIKE '%-05' AND month NOT LIKE '%-07' THEN 'date,calls' END AS columns, "
    "CASE WHEN month NOT LIKE '%-05' AND month NOT LIKE '%-07' THEN 'timestamp=date,call_volume=calls' END AS mapping FROM m",
)
def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = uploads.summarise(uploads.decode(_payloads(spark, sf_dir)))
    pairs = F.transform(F.map_entries("column_mapping"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("columns", F.array_join("columns", ",")).withColumn("mapping", F.array_join(pairs, ",")).drop("column_mapping")


@catalog.query(
    "upload_rows",
    cte("daily") + f"SELECT strftime(date, '%Y-%m') || '.csv' AS name, strftime(date, '%Y-%m-%d') AS date, {i('n', 'calls')} FROM daily WHERE month(date) NOT IN (5, 7)",
)
def upload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = uploads.rows(uploads.decode(_payloads(spark, sf_dir)))
    return rows.select("name", F.col("values")["date"].alias("date"), F.col("values")["calls"].cast("bigint").alias("calls"))


@catalog.query(
    "upload_quoted_rows",
    "SELECT o_custkey % 50 AS file, o_orderkey, o_orderpriority || chr(10) || 'cust; ' || o_custkey || ', \"key\"' AS note, strftime(o_orderdate, '%Y-%m-%d') AS day, 'day' AS time_column FROM orders",
)
def upload_quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fifty uploads whose notes hold line breaks, separators and quotes; the time column
    has a name of no known role and is found by its values."""
    o = base.table(spark, sf_dir, "orders")
    note = F.concat(F.col("o_orderpriority"), F.lit('\ncust; '), F.col("o_custkey"), F.lit(', ""key""'))
    line = F.concat(F.lit('"'), note, F.lit('",'), F.col("o_orderkey"), F.lit(","), F.date_format("o_orderdate", "yyyy-MM-dd"))
    parts = o.select((F.col("o_custkey") % 50).alias("file"), (F.col("o_custkey") % 4000).alias("part"), line.alias("line"))
    # Files of a few hundred lines, so a batch grows in files and not in their length.
    files_ = parts.groupBy("file", "part").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    payloads = files_.select(
        F.concat_ws(".", "file", "part", F.lit("csv")).alias("name"), F.lit("calls").alias("type"),
        F.base64(F.encode(F.concat(F.lit("Note,Key,Day\n"), F.col("body")), "utf-8")).alias("content"),
    )
    decoded = uploads.decode(payloads)
    found = uploads.summarise(decoded).select("name", F.col("column_mapping")["timestamp"].alias("time_column"))
    v = F.col("values")
    read = uploads.rows(decoded).select(
        "name", F.substring_index("name", ".", 1).cast("bigint").alias("file"), v["key"].cast("bigint").alias("o_orderkey"),
        v["note"].alias("note"), v["day"].alias("day"),
    )
    return read.join(found, "name").drop("name")


@catalog.query("upload_totals", cte("daily", m="SELECT DISTINCT year(date) AS y, month(date) AS m FROM daily")
               + "SELECT count(*) AS total_files, count(*) FILTER (m NOT IN (5,7)) AS successful, count(*) FILTER (m IN (5,7)) AS failed FROM m")
def upload_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.totals(uploads.summarise(uploads.decode(_payloads(spark, sf_dir))))


@catalog.query(
    "report_tables",
    cte("compared", "wide")
    + "SELECT 'forecast' AS sheet, count(*) AS rows FROM compared UNION ALL SELECT 'hourly_plan', count(*) FROM wide WHERE hour(ts) BETWEEN 8 AND 19 UNION ALL "
    "SELECT 'daily_summary', count(DISTINCT ts::DATE) FROM wide WHERE hour(ts) BETWEEN 8 AND 19 UNION ALL "
    "SELECT 'weekly_summary', count(DISTINCT (isoyear(ts), weekofyear(ts))) FROM wide WHERE hour(ts) BETWEEN 8 AND 19 UNION ALL "
    "SELECT 'historical_daily', count(DISTINCT ts::DATE) FROM wide",
)
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the full report after writing and reading it."""
    path = new_work_path(spark, "report")
    sheets = stores.report(
        base.compared(spark, sf_dir), staffing.plan(spark, sf_dir), base.wide(spark, sf_dir), ["call_volume", "email_count"]
    )
    stores.write_report(sheets, path)
    counts = [spark.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("sheet"), "rows") for n in sheets]
    return reduce(DataFrame.unionByName, counts)


# Sheet -> what names its rows, in both engines, and its cells.
_SHEETS = {
    "forecast": ("concat_ws(' ', task, date_format(ts, 'yyyy-MM-dd HH:mm'))", ["yhat", "y"]),
    "hourly_plan": ("date_format(ts, 'yyyy-MM-dd HH:mm')", ["total_volume", "total_agents"]),
    "daily_summary": ("date_format(date, 'yyyy-MM-dd')", ["total_volume", "peak_agents", "avg_agents"]),
    "weekly_summary": ("concat_ws('-', iso_year, week)", ["total_volume", "peak_agents", "avg_agents"]),
    "historical_daily": ("date_format(date, 'yyyy-MM-dd')", ["call_volume", "email_count"]),
}
_STAFF = "sum(total_volume) AS total_volume, max(total_agents) AS peak_agents, round_even(avg(total_agents), 1) AS avg_agents FROM plan"
_SHEET_SQL = {
    "forecast": "SELECT task || strftime(ts, ' %Y-%m-%d %H:%M') AS label, yhat, y FROM compared",
    "hourly_plan": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS label, total_volume, total_agents FROM plan",
    "daily_summary": f"SELECT strftime(ts, '%Y-%m-%d') AS label, {_STAFF} GROUP BY 1",
    "weekly_summary": f"SELECT isoyear(ts) || '-' || weekofyear(ts) AS label, {_STAFF} GROUP BY 1",
    "historical_daily": "SELECT strftime(ts, '%Y-%m-%d') AS label, sum(call_volume) AS call_volume, sum(email_count) AS email_count FROM wide GROUP BY 1",
}


@catalog.query(
    "report_cells",
    cte("compared", "wide", **staffing.plan_parts())
    + " UNION ALL ".join(
        f"SELECT '{n}' AS sheet, label, '{c}' AS measure, {r(c, 'cell')} FROM ({_SHEET_SQL[n]})" for n, (_, cells) in _SHEETS.items() for c in cells
    ),
)
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of the full report's tables after writing and reading them as CSV."""
    path = new_work_path(spark, "report-cells")
    sheets = stores.report(
        base.compared(spark, sf_dir), staffing.plan(spark, sf_dir), base.wide(spark, sf_dir), ["call_volume", "email_count"]
    )
    stores.write_report(sheets, path, "csv")
    out = []
    for name, (label, cells) in _SHEETS.items():
        read = spark.read.option("header", True).option("escape", '"').schema(sheets[name].schema).csv(f"{path}/{name}")
        long = read.select(F.expr(label).alias("label"), *[F.col(c).cast("double") for c in cells])
        long = long.unpivot("label", cells, "measure", "cell")
        out.append(long.select(F.lit(name).alias("sheet"), "label", "measure", "cell"))
    return reduce(DataFrame.unionByName, out)


# --- streams --------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = base.table(spark, sf_dir, "events").schema
    mapping = F.create_map(*[F.lit(v) for kv in base.EVENT_TASKS.items() for v in kv])
    events = live.read_records(spark, sf_dir, schema, "events.parquet")
    return events.select("event_id", "user_id", "event_type", (F.col("user_id") % 10).alias("site"), mapping[F.col("event_type")].alias("task"), "ts", "value")


def _closing(spark: SparkSession, sf_dir: str, label: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream and what closes it, two days after the last record."""
    closing = live.Closing(_stream(spark, sf_dir), label)

    def close() -> None:
        last = base.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
        closing.close(last + timedelta(days=2))

    return closing.stream, close


@catalog.query("live_hourly", cte("hourly") + f"SELECT site, task, {t()}, {r('volume', 'volume')} FROM hourly")
def live_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream up to its last hour: the same as in one batch."""
    stream, close = _closing(spark, sf_dir, "live-hourly")
    path = live.write_available(live.live_hourly(stream, SERIES), "live-hourly", close=close)
    return spark.read.parquet(path)


@catalog.query(
    "live_monitor",
    cte("compared", "hourly_all", fin="SELECT c.task, yhat, h.volume AS y FROM compared c JOIN hourly_all h ON h.task = c.task AND h.ts = c.ts")
    + f"SELECT task, {i('count(*)', 'n')}, {r('avg(abs(yhat-y))', 'mae')}, {r('avg(yhat-y)', 'bias')} FROM fin GROUP BY task",
)
def live_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the stored forecast against all hours, batch by batch."""
    path = new_work_path(spark, "monitor")
    stored = persist_to_shared(base.compared(spark, sf_dir).select("task", "ts", "yhat"), "stored-forecast")
    stream, close = _closing(spark, sf_dir, "monitor")
    for before in (lambda: None, close):
        before()
        hours = live.live_hourly(stream, ["task"])
        live.monitor(hours, stored, ["task"], path, f"{path}-progress").awaitTermination()
    return live.monitor_totals(spark, path, ["task"])


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures and purchases successes, of few enough accounts that bursts occur."""
    e = base.table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    return e.select((F.col("user_id") % 3).alias("user"), "ts", (F.col("event_type") == "purchase").alias("success"), "event_id")


_ATT = "SELECT user_id % 3 AS u, ts, event_type = 'purchase' AS ok, event_id FROM events WHERE event_type IN ('error', 'purchase')"
_EPOCH = "SELECT *, count(*) FILTER (ok) OVER (PARTITION BY u ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM att"
_FAILS = "SELECT u, ts, count(*) OVER (PARTITION BY u, ep ORDER BY ts RANGE BETWEEN INTERVAL {} PRECEDING AND CURRENT ROW) AS f FROM ep WHERE NOT ok"


@catalog.query(
    "lockouts",
    cte(att=_ATT, ep=_EPOCH, fl=_FAILS.format("'899.999999 seconds'"))
    + f"SELECT u AS user, {t()}, f AS failures, {t('ts + INTERVAL 15 MINUTE', 'locked_until')} FROM fl WHERE f >= 2",
)
def lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure bursts; two suffice here so that also small tables have some."""
    return lockout.lockouts(_attempts(spark, sf_dir), order="event_id", max_attempts=2)


@catalog.query(
    "lockout_rule",
    cte(att=_ATT.replace("user_id % 3", "user_id"), ep=_EPOCH, fl=_FAILS.format("'86399.999999 seconds'"))
    + f"SELECT u AS user, {t()}, f AS failures, {t('ts + INTERVAL 1440 MINUTE', 'locked_until')} FROM fl WHERE f >= 3",
)
def lockout_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule on each user: three failures within a day."""
    e = base.table(spark, sf_dir, "events").filter("event_type IN ('error', 'purchase')")
    attempts = e.select(F.col("user_id").alias("user"), "ts", (F.col("event_type") == "purchase").alias("success"), "event_id")
    return lockout.lockouts(attempts, order="event_id", max_attempts=3, minutes=1440)


@catalog.query(
    "failure_bursts",
    cte(att=_ATT, ep=_EPOCH, fl=_FAILS.format("'86399.999999 seconds'"))
    + f"SELECT u AS user, {t()}, f AS failures, {t('ts + INTERVAL 1440 MINUTE', 'locked_until')} FROM fl WHERE f >= 5",
)
def failure_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five failures without a success within a day."""
    return lockout.lockouts(_attempts(spark, sf_dir), order="event_id", minutes=1440)


_BURSTS = _FAILS.format("'86399.999999 seconds'")


@catalog.query(
    "live_lockouts",
    cte(att=_ATT.replace("user_id % 3", "user_id"), ep=_EPOCH, fl=_BURSTS)
    + f"SELECT u AS user, {t()}, {t('ts + INTERVAL 1440 MINUTE', 'locked_until')} FROM fl WHERE f >= 2",
)
def live_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two failures of a user within a day, found on a stream with state per user and day."""
    stream = _stream(spark, sf_dir).filter("event_type IN ('error', 'purchase')").select(
        F.col("user_id").alias("user"), "ts", (F.col("event_type") == "purchase").alias("success")
    )
    bursts = lockout.live_lockouts(stream, max_attempts=2, minutes=1440)
    return spark.read.parquet(live.write_available(bursts, "live-lockouts", settings=lockout.STATE_STORE))


_SESSIONS = {
    "ev": "SELECT user_id AS u, ts, {cut} AS brk FROM events",
    "num": "SELECT u, ts, sum(brk) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM ev",
    "ses": "SELECT u, s, min(ts) AS a, max(ts) AS b, count(*) AS n FROM num GROUP BY u, s",
}


def _session_sql(strict: str) -> dict[str, str]:
    cut = f"CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) {strict} INTERVAL 60 MINUTE THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END"
    return {**_SESSIONS, "ev": _SESSIONS["ev"].format(cut=cut)}


_SES = f"SELECT u AS user, {t('a', 'start')}, {t('b', 'end').replace('AS end', 'AS ' + chr(34) + 'end' + chr(34))}, n AS events FROM ses"


@catalog.query("activity_sessions", cte(**_session_sql(">")) + _SES)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user, at most an hour between two actions."""
    return sessions.sessions(base.table(spark, sf_dir, "events"), "user_id")


@catalog.query("live_sessions", cte(**_session_sql(">")) + _SES)
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream, also those open at its end: the same as in one batch."""
    stream, close = _closing(spark, sf_dir, "live-sessions")
    path = live.write_available(sessions.live_sessions(stream, "user_id"), "live-sessions", close=close)
    return spark.read.parquet(path)


@catalog.query(
    "audit_counts",
    "SELECT (user_id % 10)::VARCHAR AS user, event_type AS action, CASE WHEN value > 50 THEN 'failure' ELSE 'success' END AS outcome, count(*) AS n, "
    f"{t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')} FROM events GROUP BY user_id % 10, event_type, value > 50",
)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions parsed from JSON log lines by user, action and outcome."""
    e = base.table(spark, sf_dir, "events")
    lines = sessions.log_line(
        e.select(
            F.col("ts").alias("timestamp"), F.when(F.col("value") > 50, "WARNING").otherwise("INFO").alias("level"),
            (F.col("user_id") % 10).cast("string").alias("user"), F.col("event_type").alias("action"),
            F.create_map(F.lit("value"), F.col("value").cast("string")).alias("details"),
        )
    )
    return sessions.audit_counts(sessions.audit_records(lines))
