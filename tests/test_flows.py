"""Readers, uploads, stores and streams on small files."""

import base64
import gzip
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shiftcast.functions.clock import ntz
from shiftcast.session import new_work_path, persist_to_shared, shared_dir
from shiftcast.sources import files, loaders, stores, uploads
from shiftcast.streaming import live, lockout, sessions


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_separator_and_header_names(spark, tmp_path):
    a = put(tmp_path, "a.csv", "Time Stamp; Call Volume\n2024-01-01 00:00:00;3\n")
    df = files.read_delimited(spark, a)
    assert df.columns == ["time_stamp", "call_volume"]
    b = put(tmp_path, "b.csv", "x,y\n1,2\n")
    assert files.read_delimited(spark, b).head().asDict() == {"x": "1", "y": "2"}


def test_files_with_different_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "a,b\n1,2\n")
    put(tmp_path, "b.csv", "b;c\n3;4\n")
    rows = {tuple(r.asDict().items()) for r in files.read_delimited(spark, str(tmp_path)).collect()}
    assert rows == {(("a", "1"), ("b", "2"), ("c", None)), (("a", None), ("b", "3"), ("c", "4"))}


def test_first_lines_of_files(spark, tmp_path, monkeypatch):
    """Headers longer than what is read at once, other line ends, marks, packed and empty files."""
    monkeypatch.setattr(files, "HEAD_BYTES", 4)
    long = ",".join(f"column_{k}" for k in range(500))
    put(tmp_path, "a b.csv", f"{long}\n1\n")
    (tmp_path / "marked.csv").write_bytes("\ufeffä;b\r\n1;2\r\n".encode())
    (tmp_path / "old.csv").write_bytes(b"x,y\r1,2\r")
    (tmp_path / "packed.csv.gz").write_bytes(gzip.compress(b"p,q\n1,2\n"))
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "open.csv", "only")
    expected = {"a%20b.csv": long, "marked.csv": "ä;b", "old.csv": "x,y", "packed.csv.gz": "p,q", "open.csv": "only"}
    for read in (files.headers, files.headers_by_scan):
        assert {r["path"].rsplit("/", 1)[1]: r["header"] for r in read(spark, str(tmp_path)).collect()} == expected
    assert files.first_line((tmp_path / "empty.csv").as_uri()) is None
    # Another kind of file system, which only Spark's readers may know.
    assert not files._readable("other://host/x.csv")


def test_files_are_scanned_once(spark, tmp_path):
    """Three headers in five files: one scan, records with quotes, short lines, blank and repeated header lines."""
    put(tmp_path, "a.csv", 'a,b\n1,"x, ""y"""\n\n2\n')
    put(tmp_path, "a2.csv", "a,b\n3,\na,b\n")
    put(tmp_path, "b.csv", "B;c\n4;5;6\n")
    put(tmp_path, "c.csv", "a,a\n7,8\n")
    put(tmp_path, "d.csv", "")
    df = files.read_delimited(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c"]
    key = lambda t: tuple(x or "" for x in t)
    rows = [("", "4", "5"), ("1", 'x, "y"', ""), ("2", "", ""), ("3", "", ""), ("7", "", "")]
    assert sorted(key(r) for r in df.collect()) == rows
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] text") == 1
    with pytest.raises(ValueError):
        files.read_roles(spark, str(tmp_path), {"c": ("c",)}, {})
    with pytest.raises(FileNotFoundError):
        files.read_delimited(spark, str(tmp_path / "d.csv"))


def test_loaders(spark, tmp_path):
    put(tmp_path, "calls_jan.csv", "Datum;Anzahl\n01.02.2024 08:15;4\n01.02.2024 08:45;1\n")
    put(tmp_path, "inbound_call_log.csv", "timestamp,queue\n2024-02-01 08:59:59,a\n2024-02-01 09:00:00,b\n")
    put(tmp_path, "emails.csv", "date,email_count\n2024-02-01 08:00,7\n")
    put(tmp_path, "outbound.csv", "time,typ,count\n2024-02-01 08:00:00, ook ,2\n2024-02-01 08:30:00,NB,1\n2024-02-01 08:30:00,,9\n")
    base = str(tmp_path)
    calls = loaders.load_calls(spark, base).orderBy("ts").collect()
    assert [(str(r["ts"]), r["volume"]) for r in calls] == [("2024-02-01 08:00:00", 6), ("2024-02-01 09:00:00", 1)]
    outbound = {r["task"]: r["volume"] for r in loaders.load_outbound(spark, base).collect()}
    assert outbound == {"outbound_ook": 2, "outbound_nb": 1}
    assert loaders.load_all(spark, base).count() == 5
    assert loaders.load_emails(spark, str(tmp_path / "none")).count() == 0


def test_missing_type_column_is_unknown(spark, tmp_path):
    put(tmp_path, "outbound.csv", "timestamp\n2024-02-01 08:00:00\n2024-02-01 08:10:00\n")
    row = loaders.load_outbound(spark, str(tmp_path)).head()
    assert (row["task"], row["volume"]) == ("outbound_unknown", 2)


def test_mapping_by_name_and_by_content(spark):
    df = spark.createDataFrame([("3", "x", "01.02.2024")], ["Anrufe", "note", "wann"])
    assert files.detect_mapping(df) == {"call_volume": "Anrufe", "timestamp": "wann"}
    named = spark.createDataFrame([("1", "2", "3")], ["Zeit", "OOK", "E-Mail"])
    assert files.detect_mapping(named) == {"timestamp": "Zeit", "outbound_ook": "OOK", "email_count": "E-Mail"}
    assert files.detect_mapping(spark.createDataFrame([("x",)], ["y"])) == {}


@pytest.mark.parametrize("text", ["2024-03-31 02:30:00", "31.03.2024 02:30", "31/03/2024 02:30:00", "2024-03-31T02:30"])
def test_time_layouts(spark, text):
    df = files.parse_timestamp(spark.createDataFrame([(text,)], "t string"), "t")
    assert str(df.head()["t"]) == "2024-03-31 02:30:00"


def test_unreadable_times_are_null(spark):
    df = spark.createDataFrame([("31.02.2024 10:00",), ("later",), ("01.02.2024",)], "t string")
    assert [r["t"] and str(r["t"]) for r in files.parse_timestamp(df, "t").collect()] == [None, None, "2024-02-01 00:00:00"]


def test_leads(spark):
    df = spark.createDataFrame([("01.02.2024", "12.7"), ("bad", "3"), ("2024-03-01", "x"), ("2024-03-02", "5")], ["d", "n"])
    assert [(str(r["date"]), r["leads"]) for r in files.read_leads(df).collect()] == [("2024-02-01", 12), ("2024-03-02", 5)]


def test_csv_round_trip_and_inventory(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2).withColumn("note", F.lit('say "a, b"'))
    stores.write_csv(df, str(tmp_path / "out"))
    again = files.read_delimited(spark, str(tmp_path / "out"))
    assert sorted((int(r["x"]), r["note"]) for r in again.collect()) == [(2 * i, 'say "a, b"') for i in range(10)]
    listed = files.file_inventory(spark, str(tmp_path / "out" / "*.csv")).collect()
    assert sum(r["rows"] for r in listed) == 10 and all(r["size_bytes"] > 0 for r in listed)


def test_hourly_store_prunes_months(spark, series, tmp_path):
    path = str(tmp_path / "h")
    stores.write_hourly(series([1] * 24 * 70), path)
    inside = stores.read_hourly(spark, path, "2024-02-05 00:00:00", "2024-02-05 23:00:00")
    assert inside.count() == 24
    assert "PartitionFilters: [isnotnull(month" in inside._jdf.queryExecution().executedPlan().toString()


def test_uploads(spark):
    def b64(text):
        return base64.b64encode(text.encode()).decode()

    rows = [
        ("a.csv", "calls", b64("Date;Calls\r\n2024-01-01;3\r\n2024-01-02;4\r\n")), ("b.csv", "calls", "###"),
        ("c.csv", "calls", b64("\n")), ("d.txt", "calls", b64("x,y\n1,2")),
    ]
    decoded = uploads.decode(spark.createDataFrame(rows, "name string, type string, content string"))
    out = {r["name"]: r for r in uploads.summarise(decoded).collect()}
    assert out["a.csv"]["rows"] == 2 and out["a.csv"]["column_mapping"] == {"timestamp": "date", "call_volume": "calls"}
    assert [out[n]["error"] for n in ("b.csv", "c.csv", "d.txt")] == ["NOT_BASE64", "EMPTY_FILE", "UNSUPPORTED_FORMAT"]
    assert [r["values"] for r in uploads.rows(decoded).collect()] == [{"date": "2024-01-01", "calls": "3"}, {"date": "2024-01-02", "calls": "4"}]
    total = uploads.totals(uploads.summarise(decoded)).head()
    assert (total["total_files"], total["successful"], total["failed"]) == (4, 1, 3)


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert new_work_path(spark, "x") != new_work_path(spark, "x")
    assert persist_to_shared(spark.range(7), "t").count() == 7


# --- streams --------------------------------------------------------------------


def attempts(spark, rows):
    df = spark.createDataFrame([(u, float(m), ok) for u, m, ok in rows], "user string, minute double, success boolean")
    at = ntz("2024-01-01 12:00:00") + F.make_dt_interval(mins=F.lit(0), secs=(F.col("minute") * 60).cast("decimal(18,6)"))
    return df.select("user", at.alias("ts"), "success")


CASES = {
    "quick": [(0, False), (3, False), (6, False), (9, False), (14, False)],
    "slow": [(0, False), (3, False), (6, False), (9, False), (15, False)],
    "cleared": [(0, False), (3, False), (6, False), (7, True), (9, False), (10, False)],
    "again": [(0, False), (1, False), (2, False), (3, False), (4, False), (5, False)],
}


def test_lockouts(spark):
    rows = [(u, m, ok) for u, seq in CASES.items() for m, ok in seq]
    out = lockout.lockouts(attempts(spark, rows)).collect()
    assert sorted((r["user"], r["ts"].minute, r["failures"]) for r in out) == [("again", 4, 5), ("again", 5, 6), ("quick", 14, 5)]
    assert next(r for r in out if r["user"] == "quick")["locked_until"].minute == 29


def brute_lockouts(rows, limit=5, minutes=15):
    """The rule applied to one attempt after the other."""
    recent, found = {}, []
    for at, user, ok in sorted(rows):
        if ok:
            recent[user] = []
            continue
        kept = [t for t in recent.get(user, []) if t > at - timedelta(minutes=minutes)] + [at]
        recent[user] = kept
        if len(kept) >= limit:
            found.append((user, at, len(kept)))
    return sorted(found)


def random_attempts(n=1500, seed=13):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    # One account makes most of the attempts.
    return [
        (start + timedelta(seconds=rng.randrange(0, 2 * 86400), microseconds=k), "hot" if rng.random() < 0.7 else f"u{rng.randrange(3)}", rng.random() < 0.15)
        for k in range(n)
    ]


def test_lockouts_equal_the_sequential_rule(spark):
    rows = random_attempts()
    df = spark.createDataFrame([(u, at.isoformat(sep=" "), ok) for at, u, ok in rows], "user string, ts string, success boolean")
    out = lockout.lockouts(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()
    assert sorted((r["user"], r["ts"], r["failures"]) for r in out) == brute_lockouts(rows)


def write_batches(spark, df, folder, parts):
    """One file per time slice, so that a stream sees them as separate batches."""
    rows = df.orderBy("ts").collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        part = spark.createDataFrame(rows[k * size:(k + 1) * size], df.schema).coalesce(1)
        part.write.parquet(f"{folder}/p{k}")


def test_live_lockouts_over_many_batches(spark, tmp_path):
    rows = random_attempts(400, seed=17)
    df = spark.createDataFrame([(u, at.isoformat(sep=" "), ok) for at, u, ok in rows], "user string, ts string, success boolean")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    write_batches(spark, df, str(tmp_path), 4)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/p*")
    out = spark.read.parquet(live.write_available(lockout.live_lockouts(stream, max_attempts=3), "t-lockouts", settings=lockout.STATE_STORE)).collect()
    # Files of one listing carry almost the same time; the state must bridge them in any order of arrival that keeps time order.
    assert sorted((r["user"], r["ts"]) for r in out) == [(u, at) for u, at, _ in brute_lockouts(rows, 3)]


def test_live_lockouts_of_one_hot_account(spark, tmp_path):
    """Nine of ten attempts are one account's; each of its slices is a group of its own."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = sorted((start + timedelta(seconds=rng.randint(0, 86_400), microseconds=k), "hot" if rng.random() < 0.9 else "cold", rng.random() < 0.2) for k in range(600))
    df = spark.createDataFrame([(u, at.isoformat(sep=" "), ok) for at, u, ok in rows], "user string, ts string, success boolean")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    write_batches(spark, df, str(tmp_path), 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path = live.write_available(lockout.live_lockouts(stream), "t-hot", settings=lockout.STATE_STORE)
    out = spark.read.parquet(path).collect()
    assert sorted((r["user"], r["ts"]) for r in out) == [(u, at) for u, at, _ in brute_lockouts(rows)] and len(out) > 20
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_live_lockouts_of_many_accounts_in_few_groups(spark, tmp_path):
    """State is kept per group and slice, not per account: accounts of one group stay apart, as do those unknown."""
    rng = random.Random(23)
    start = datetime(2024, 1, 1)
    rows = sorted((start + timedelta(seconds=rng.randint(0, 14_400), microseconds=k), 2**60 + rng.randint(0, 11), rng.random() < 0.1) for k in range(900))
    known = lambda u: None if u == 2**60 else u
    df = spark.createDataFrame([(known(u), at.isoformat(sep=" "), ok) for at, u, ok in rows], "user long, ts string, success boolean")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    write_batches(spark, df, str(tmp_path), 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/p*")
    found = lockout.live_lockouts(stream, max_attempts=3, groups=2)
    out = spark.read.parquet(live.write_available(found, "t-groups", settings=lockout.STATE_STORE)).collect()
    wanted = [(known(u), at) for u, at, _ in brute_lockouts(rows, 3)]
    assert {(r["user"], r["ts"]) for r in out} == set(wanted) and len(out) == len(wanted) > 50
    assert any(u is None for u, _ in wanted)


def test_live_hourly_drops_late_rows(spark, tmp_path):
    def rows(*texts):
        return spark.createDataFrame([("calls", t) for t in texts], "task string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    first = rows("2024-01-01 08:10:00", "2024-01-01 08:50:00", "2024-01-01 12:00:00")
    first.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark_path = f"{tmp_path}/in/*"
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = spark.readStream.schema(first.schema).parquet(spark_path)
        q = live.live_hourly(stream, ["task"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((str(r["ts"]), r["volume"]) for r in spark.read.parquet(out).collect())

    assert run() == [("2024-01-01 08:00:00", 2.0)]
    rows("2024-01-01 08:20:00", "2024-01-01 16:30:00").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    # The late row of 08:20 changes nothing; 12:00 has become final.
    assert run() == [("2024-01-01 08:00:00", 2.0), ("2024-01-01 12:00:00", 1.0)]


def test_sessions(spark):
    df = attempts(spark, [("a", 0, True), ("a", 59, True), ("b", 0, True), ("b", 61, True), ("c", 0, True), ("c", 60, True)])
    out = sessions.sessions(df).groupBy("user").count().collect()
    assert {r["user"]: r["count"] for r in out} == {"a": 1, "b": 2, "c": 1}


def test_session_over_midnight(spark):
    df = attempts(spark, [("a", 60 * 11 + 50, True), ("a", 60 * 12 + 10, True), ("a", 60 * 12 + 30, True)])
    row = sessions.sessions(df).head()
    assert row["events"] == 3 and str(row["start"]) == "2024-01-01 23:50:00" and str(row["end"]) == "2024-01-02 00:30:00"


def test_audit_lines(spark):
    lines = ['{"timestamp": "2024-01-01T10:00:00Z", "level": "WARNING", "user": "x", "action": "login", "details": {}}', "no json",
             '{"timestamp": "2024-01-01T11:00:00Z", "level": "INFO", "user": "x", "action": "login"}']
    out = sessions.audit_counts(sessions.audit_records(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()
    assert sorted((r["outcome"], r["n"]) for r in out) == [("failure", 1), ("success", 1)]


@pytest.mark.parametrize("master", ["local[2]", "spark://host:7077"])
def test_folder_without_setting(master):
    from types import SimpleNamespace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    if master.startswith("local"):
        assert shared_dir(bare) == shared_dir(bare)
    else:
        # A machine-local folder would be wrong on a cluster.
        with pytest.raises(RuntimeError):
            shared_dir(bare)
