"""Delimited files whose headers, separators and time formats vary."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import persist_to_shared

#: What a file is opened for at once to find its header.
HEAD_BYTES = 1024
#: Different headers below one path, each a branch of the plan.
MOST_LAYOUTS = 500
#: Up to so many files their layouts go to the records as a broadcast, some 200 bytes each; more are joined.
BROADCAST_FILES = 100_000

LINE_END = re.compile(rb"\r\n|\r|\n")
BOM = "\ufeff"

# Column names accepted per role, the first present one wins.
TIMESTAMP_NAMES = ("timestamp", "date", "datetime", "time", "datum", "zeit")
CALL_NAMES = ("call_volume", "calls", "volume", "count", "anzahl")
EMAIL_NAMES = ("email_count", "emails", "count", "anzahl", "volume")
TYPE_NAMES = ("type", "typ", "category", "kategorie", "art")
OUTBOUND_COUNT_NAMES = ("count", "volume", "anzahl", "amount")

# Names under which a wide upload may carry each workload column.
UPLOAD_NAMES = {
    "timestamp": ("timestamp", "date", "datetime", "zeit", "datum", "time"),
    "call_volume": ("call_volume", "calls", "call", "anrufe", "inbound_calls", "call_count"),
    "email_count": ("email_count", "emails", "email", "e-mail", "mail_count", "mails"),
    "outbound_ook": ("outbound_ook", "ook", "order_confirmation"),
    "outbound_omk": ("outbound_omk", "omk", "customer_contact"),
    "outbound_nb": ("outbound_nb", "nb", "follow_up", "nachbearbeitung"),
    "outbound_total": ("outbound_total", "outbound", "total_outbound"),
}

# Time layouts tried in this order: what the text looks like, and how its parts
# form an ISO time. Casting ISO text to TIMESTAMP_NTZ involves no time zone.
LAYOUTS = (
    ("iso", r"^(\d{4}-\d{1,2}-\d{1,2})(?:[ T](\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?(?:Z)?$", "$1 $2"),
    ("dotted", r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?: (\d{1,2}:\d{2}(?::\d{2})?))?$", "$3-$2-$1 $4"),
    ("slashed", r"^(\d{1,2})/(\d{1,2})/(\d{4})(?: (\d{1,2}:\d{2}(?::\d{2})?))?$", "$3-$2-$1 $4"),
)


def normalise(name: str) -> str:
    return name.lower().strip().replace(" ", "_")


def separator_of(header: str) -> str:
    """Semicolon if it yields at least two columns, else comma."""
    return ";" if len(header.split(";")) >= 2 else ","


def first_line(uri: str) -> str | None:
    """The first line of a file, of which only the first kilobytes are read; None of an empty file."""
    store, name = fs.FileSystem.from_uri(uri)
    head = b""
    with store.open_input_stream(name) as f:
        while not LINE_END.search(head) and (more := f.read(HEAD_BYTES)):
            head += more
    return LINE_END.split(head, 1)[0].decode("utf-8", "replace").removeprefix(BOM) if head else None


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        yield pd.DataFrame({"path": files["path"], "header": [first_line(p) for p in files["path"]]})


def _readable(uri: str) -> bool:
    """Whether the kind of file system is one that a task can open by itself."""
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(path, header)`` of each file that is not empty.

    The listing of the files carries no content. Each task opens the files of its bundle for
    their first kilobytes; where only Spark's own readers know the file system, their first
    lines come from a scan.
    """
    listing = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    one = listing.first()
    if one is None or _readable(one["path"]):
        return listing.mapInPandas(_first_lines, "path string, header string").na.drop()
    return headers_by_scan(spark, paths)


def headers_by_scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same through Spark's text reader, which reads the files whole."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    first = lines.filter("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header"))
    return first.withColumn("header", F.regexp_replace("header", f"^{BOM}", ""))


@dataclass(frozen=True)
class Layout:
    """A header, its separator and its normalised column names."""

    header: str
    sep: str
    names: tuple[str, ...]

    @classmethod
    def of(cls, header: str, sep: str = "auto") -> Layout:
        sep = separator_of(header) if sep == "auto" else sep
        return cls(header, sep, tuple(normalise(c.strip('"')) for c in header.split(sep)))


def _records(spark: SparkSession, paths: str | list[str], sep: str) -> tuple[DataFrame | None, list[Layout]]:
    """The records of all files in one scan, with a struct of text fields per layout, which is NULL
    for files of another; and the layouts in the order of their first files.

    A line equal to its file's header is no record, wherever it stands; a blank line neither.
    The driver sees one row per layout.
    """
    heads = persist_to_shared(headers(spark, paths), "headers")
    kinds = heads.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").limit(MOST_LAYOUTS + 1).collect()
    if len(kinds) > MOST_LAYOUTS:
        raise ValueError(f"more than {MOST_LAYOUTS} different headers below {paths!r}")
    layouts = [Layout.of(k["header"], sep) for k in kinds]
    if not layouts:
        return None, []
    known = F.array(*[F.lit(l.header) for l in layouts])
    lines = spark.read.text(paths).select(
        F.regexp_replace("value", f"^{BOM}", "").alias("line"), F.col("_metadata.file_path").alias("path")
    )
    if len(layouts) == 1:
        lines = lines.withColumn("layout", F.lit(0))
    else:
        numbers = heads.select("path", (F.array_position(known, F.col("header")) - 1).cast("int").alias("layout"))
        lines = lines.join(F.broadcast(numbers) if heads.count() <= BROADCAST_FILES else numbers, "path")
    lines = lines.filter((F.col("line") != F.get(known, "layout")) & (F.trim("line") != ""))
    structs = {}
    for k, l in enumerate(layouts):
        schema = ", ".join(f"_{i} string" for i in range(len(l.names)))
        structs[f"_l{k}"] = F.when(F.col("layout") == k, F.from_csv("line", schema, {"sep": l.sep, "escape": '"'}))
    return lines.withColumns(structs), layouts


def _field(layout: int, names: tuple[str, ...], name: str) -> Column:
    return F.col(f"_l{layout}")[f"_{names.index(name)}"]


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str = "auto") -> DataFrame:
    """All files of a path or glob as text columns; columns missing from some files are NULL there.

    Each byte is read once however many headers there are."""
    records, layouts = _records(spark, paths, sep)
    if records is None:
        raise FileNotFoundError(f"no rows below {paths!r}")
    names = dict.fromkeys(n for l in layouts for n in l.names)
    return records.select(
        *[F.coalesce(*[_field(k, l.names, n) for k, l in enumerate(layouts) if n in l.names]).alias(n) for n in names]
    )


def read_roles(
    spark: SparkSession, paths: str | list[str], roles: dict[str, tuple[str, ...]], defaults: dict[str, str], sep: str = "auto"
) -> DataFrame:
    """One text column per role: in each file the first of the role's names that its header has.

    A file without any of them gives the role's default; without one either, that is an error.
    """
    records, layouts = _records(spark, paths, sep)
    if records is None:
        return spark.createDataFrame([], ", ".join(f"{role} string" for role in roles))
    out = []
    for role, names in roles.items():
        found = []
        for k, l in enumerate(layouts):
            name = next((n for n in names if n in l.names), None)
            if name is None and role not in defaults:
                raise ValueError(f"no {role} column among {list(l.names)}")
            found.append(_field(k, l.names, name) if name else F.when(F.col("layout") == k, F.lit(defaults[role])))
        out.append(F.coalesce(*found).alias(role))
    return records.select(*out)


def read_any(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV, Parquet or JSON with normalised column names."""
    if fmt == "csv":
        return read_delimited(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    return df.toDF(*[normalise(c) for c in df.columns])


def matching_paths(spark: SparkSession, base: str, pattern: str) -> list[str]:
    """Files or folders of ``base`` that match a glob, through the file system Spark uses."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{pattern}")
    fs = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(glob)
    return sorted(s.getPath().toString() for s in found) if found else []


def detect_mapping(df: DataFrame, sample: int = 10) -> dict[str, str]:
    """Role -> column by name; without a time column, the first whose first values all read as times."""
    lowered = {c.lower(): c for c in reversed(df.columns)}
    found = {
        role: next(lowered[n] for n in names if n in lowered)
        for role, names in UPLOAD_NAMES.items()
        if any(n in lowered for n in names)
    }
    if "timestamp" not in found:
        head = df.limit(sample)
        readable = head.agg(
            *[
                (F.count_if(F.col(f"`{c}`").isNotNull() & parsed(f"`{c}`").isNull()) + F.when(F.count(f"`{c}`") == 0, 1).otherwise(0)).alias(c)
                for c in df.columns
            ]
        ).head()
        for c in df.columns:
            if readable is not None and readable[c] == 0:
                found["timestamp"] = c
                break
    return found


def _layout(text: Column, index: int) -> Column:
    _, pattern, iso = LAYOUTS[index]
    clean = F.trim(text.cast("string"))
    shaped = F.trim(F.regexp_replace(clean, pattern, iso))
    return F.when(clean.rlike(pattern), shaped.try_cast("timestamp_ntz"))


def parsed(column: str | Column, layout: str | None = None) -> Column:
    """A time read from text, NULL if it cannot be; any layout unless one is named."""
    text = F.col(column) if isinstance(column, str) else column
    if layout is None:
        return F.coalesce(*[_layout(text, k) for k in range(len(LAYOUTS))])
    return _layout(text, [name for name, _, _ in LAYOUTS].index(layout))


def parse_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Reads a text column as times.

    No text fits two layouts, so the row's own layout is also that of a column which has
    one throughout: nothing is counted beforehand.
    """
    if not isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.col(column).cast("timestamp_ntz"))
    return df.withColumn(column, parsed(column))


def read_leads(df: DataFrame) -> DataFrame:
    """First column as date, second as whole number; rows that lack either are dropped."""
    if len(df.columns) < 2:
        raise ValueError("a lead file needs a date and a number column")
    date, leads = (F.col(f"`{c}`") for c in df.columns[:2])
    return (
        df.select(
            F.to_date(parsed(date)).alias("date"),
            F.trim(leads.cast("string")).try_cast("double").cast("bigint").alias("leads"),
        )
        .na.drop(subset=["date", "leads"])
    )


def file_inventory(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Name, size, time of change and rows (without the header) per file, counted where the data is."""
    return (
        spark.read.text(paths)
        .groupBy(
            F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("size_bytes"),
            F.col("_metadata.file_modification_time").alias("modified_at"),
        )
        .agg((F.count(F.lit(1)) - 1).alias("rows"))
    )
