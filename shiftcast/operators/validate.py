"""Data validation: one row per finding.

Counts of all rules on values and times come from one aggregation. Interval
rules need the order of the times; they sort inside ranges of about equal counts and
stitch the ranges together from their first and last times, so a series that
holds most of the records, or most of them in one hour, still spreads.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clock
from ..functions.numbers import humanize_seconds, ratio
from ..session import persist_to_shared
from . import quantiles
from .moments import types_of

# Names under which a workload column may arrive, and the largest
# plausible volume per hour.
VALUE_ALIASES = {
    "calls": ("calls", "call_volume"),
    "emails": ("emails", "email_count"),
    "outbound_ook": ("outbound_ook",),
    "outbound_omk": ("outbound_omk",),
    "outbound_nb": ("outbound_nb",),
    "total_workload": ("total_workload",),
}
UPPER_LIMITS = {
    "calls": 10000, "emails": 5000, "outbound_ook": 2000, "outbound_omk": 2000, "outbound_nb": 2000,
    "total_workload": 50000,
}
REQUIRED = {
    "calls": ("timestamp", "calls"),
    "emails": ("timestamp", "emails"),
    "outbound": ("timestamp", "outbound_ook", "outbound_omk", "outbound_nb"),
}

ISSUE = "code string, severity string, n bigint, details map<string,string>"


def value_columns(df: DataFrame) -> dict[str, str]:
    """Role -> column of the frame, aliases resolved."""
    return {
        role: next(a for a in aliases if a in df.columns)
        for role, aliases in VALUE_ALIASES.items()
        if any(a in df.columns for a in aliases)
    }


def structure_issues(df: DataFrame, ts: str = "ts", data_type: str | None = None) -> list[tuple]:
    """Findings the schema alone decides."""
    found = []
    roles = value_columns(df)
    if ts not in df.columns:
        found.append(("MISSING_TIMESTAMP", "error", 1, {}))
    if not roles:
        found.append(("MISSING_VALUE_COLUMNS", "error", 1, {"expected": ",".join(VALUE_ALIASES)}))
    if data_type in REQUIRED:
        have = {*roles, *(["timestamp"] if ts in df.columns else [])}
        missing = [c for c in REQUIRED[data_type] if c not in have]
        if missing:
            found.append(("MISSING_REQUIRED_COLUMNS", "warning", len(missing), {"missing": ",".join(missing), "data_type": data_type}))
    return found


def unparsable(text: str) -> Column:
    """Whether a text time is present but cannot be read."""
    return F.col(text).isNotNull() & F.try_to_timestamp(F.col(text)).isNull()


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


#: Distances of a key that a task holds before it gives them out.
DISTANCES_AT_ONCE = 100_000


def interval_counts(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``(keys, micros, n)``: how often each distance between neighbouring times occurs.

    Equal times have distance 0. The times are put into ranges of about equal counts by
    sampled split points, so a key with most of the rows, or an hour with most of a key's,
    spreads over several. A task walks through its range in order and gives out summed
    distances; between ranges they are those of the ranges' ends, one row per range and key.
    """
    seen = df.filter(F.col(ts).isNotNull()).groupBy(*keys, clock.epoch_micros(ts).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    ranged = seen.repartitionByRange(*keys, "_at").sortWithinPartitions(*keys, "_at")
    names = [*keys, "micros", "n", "first", "last"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, first, last, held = None, None, None, Counter()

        def summed(ends: bool) -> pd.DataFrame:
            out = [(*key, m, n, None, None) for m, n in held.items()]
            rows = pd.DataFrame(out + ([(*key, None, None, first, last)] if ends else []), columns=names)
            held.clear()
            return rows.astype({c: "Int64" for c in names[len(keys) :]})

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)] if len(pdf) else []
            for new, rows in groups:
                new = tuple(None if pd.isna(k) else k for k in new)
                at, repeats = rows["_at"].to_numpy(), int((rows["_n"] - 1).sum())
                if new != key:
                    if key is not None:
                        yield summed(True)
                    key, first, last = new, int(at[0]), int(at[0])
                gap, n = np.unique(np.diff(at, prepend=last), return_counts=True)
                held.update(dict(zip(gap.tolist(), n.tolist())))
                held[0] += repeats - int(last == at[0])  # the time before the first is the first itself
                last = int(at[-1])
                if len(held) >= DISTANCES_AT_ONCE:
                    yield summed(False)
        if key is not None:
            yield summed(True)

    parts = ranged.mapInPandas(walk, types_of(df, keys, *(f"{c} bigint" for c in names[len(keys) :])))
    parts = persist_to_shared(parts, "distances")
    ordered = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("first")
    ends = parts.filter("first IS NOT NULL")  # of a key as many as ranges it spreads over
    across = ends.select(*keys, (F.col("first") - F.lag("last").over(ordered)).alias("micros"), F.lit(1).cast("bigint").alias("n"))
    every = parts.select(*keys, "micros", "n").unionByName(across).filter("micros IS NOT NULL AND n > 0")
    return every.groupBy(*keys, "micros").agg(F.sum("n").alias("n"))


def intervals(df: DataFrame, keys: list[str], ts: str = "ts", factor: float = 3.0) -> DataFrame:
    """Median, largest and most frequent interval, gaps above ``factor`` medians, repeated times."""
    # Needed for the median and against it: written once, the records are read once.
    counts = persist_to_shared(interval_counts(df, keys, ts), "intervals")
    median = quantiles.quantiles_of_counts(counts, keys, "micros", {"median_micros": 0.5}).drop("n")
    joined = salted_join(counts, median, keys, "micros") if keys else counts.crossJoin(F.broadcast(median))
    most = F.min_by("micros", F.struct(-F.col("n"), F.col("micros")))
    return joined.groupBy(*keys).agg(
        (F.max("median_micros") / 1e6).alias("median_seconds"),
        (F.max("micros") / 1e6).alias("largest_seconds"),
        (most / 1e6).alias("granularity_seconds"),
        F.coalesce(F.sum(F.when(F.col("micros") > F.col("median_micros") * factor, F.col("n"))), F.lit(0)).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("micros") == 0, F.col("n"))), F.lit(0)).alias("duplicates"),
    )


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread_by: str, salts: int = 32) -> DataFrame:
    """Joins ``many`` rows per key with ``one``; a key's rows go to ``salts`` tasks.

    A plain join on the keys would leave the rows partitioned by them, and an
    aggregation by the same keys would then run a large key in a single task.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = one.withColumn("_salt", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(salts)])))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def _text(c: Column) -> Column:
    return c.cast("string")


def _issue(code: str, severity: Column | str, n: Column, details: dict[str, Column], when: Column) -> Column:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    pairs = [x for k, v in details.items() for x in (F.lit(k), _text(v))]
    body = F.struct(
        F.lit(code).alias("code"), sev.alias("severity"), n.cast("bigint").alias("n"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("details"),
    )
    return F.when(when, body)


def validate(df: DataFrame, as_of: str, ts: str = "ts", data_type: str | None = None) -> DataFrame:
    """All findings for a wide workload table: ``(code, severity, n, details)``.

    ``as_of`` stands for the present, so that results can be repeated.
    """
    spark = df.sparkSession
    fixed = structure_issues(df, ts, data_type)
    static = spark.createDataFrame(fixed, ISSUE)
    if ts not in df.columns:
        return static
    roles = value_columns(df)
    stamp = df.schema[ts].dataType
    if isinstance(stamp, T.StringType):
        broken = df.agg(_count(unparsable(ts)).alias("n")).filter("n > 0")
        static = static.unionByName(
            broken.select(
                F.lit("INVALID_TIMESTAMP_FORMAT").alias("code"), F.lit("error").alias("severity"), "n",
                F.lit(None).cast("map<string,string>").alias("details"),
            )
        )
        df = df.withColumn(ts, F.try_to_timestamp(F.col(ts)).cast("timestamp_ntz"))
    now = clock.ntz(as_of)
    at = F.col(ts)
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        _count(at > now + F.expr("INTERVAL 1 DAY")).alias("future"),
        _count(at < now - F.expr("INTERVAL 1825 DAY")).alias("old"),
        (F.floor((clock.epoch_micros(F.max(ts)) - clock.epoch_micros(F.min(ts))) / 86_400_000_000)).alias("days"),
        F.collect_set(F.hour(ts)).alias("hours"),  # at most 24 numbers
    ]
    for role, c in roles.items():
        v = F.col(c)
        aggs += [
            _count(v.isNull()).alias(f"{role}__null"),
            _count(v < 0).alias(f"{role}__negative"),
            _count(v > UPPER_LIMITS[role]).alias(f"{role}__high"),
            _count(v == 0).alias(f"{role}__zero"),
            F.max(v).cast("double").alias(f"{role}__max"),
        ]
    one = df.agg(*aggs)
    spans = intervals(df, [], ts)
    one = one.join(F.broadcast(spans), F.lit(True), "left")  # one row each
    rows, days = F.col("rows"), F.col("days")
    some = rows > 0
    unseen = F.array_sort(F.array_except(F.sequence(F.lit(0), F.lit(23)), F.col("hours")))
    many = rows > 1
    issues = [
        _issue("DATA_EMPTY", "error", rows, {}, ~some),
        _issue("FUTURE_TIMESTAMPS", "warning", F.col("future"), {}, F.col("future") > 0),
        _issue("OLD_TIMESTAMPS", "info", F.col("old"), {}, F.col("old") > 0),
        _issue(
            "DATA_GAPS", "warning", F.col("gaps"),
            {"median_interval": F.col("median_seconds"), "largest_gap": F.col("largest_seconds")}, many & (F.col("gaps") > 0),
        ),
        _issue("DUPLICATE_TIMESTAMPS", "warning", F.col("duplicates"), {}, F.col("duplicates") > 0),
        _issue(
            "TIMESTAMP_GRANULARITY", "info", F.lit(1),
            {"granularity": humanize_seconds(F.col("granularity_seconds"))}, many & F.col("granularity_seconds").isNotNull(),
        ),
        _issue("INSUFFICIENT_HISTORY", "warning", days, {}, some & (days < 30)),
        _issue("LIMITED_HISTORY", "info", days, {}, some & (days >= 30) & (days < 90)),
        _issue(
            "MISSING_HOURS", "info", F.size(unseen), {"hours": F.array_join(unseen.cast("array<string>"), ",")},
            (rows > 24) & F.size(unseen).between(1, 8),
        ),
    ]
    for role in roles:
        upper = role.upper()
        nulls, zeros = F.col(f"{role}__null"), F.col(f"{role}__zero")
        null_pct = ratio(nulls.cast("double"), rows.cast("double")) * 100
        zero_pct = ratio(zeros.cast("double"), rows.cast("double")) * 100
        grade = F.when(null_pct > 50, "error").when(null_pct > 10, "warning").otherwise("info")
        issues += [
            _issue(f"NULL_VALUES_{upper}", grade, nulls, {"pct": F.round(null_pct, 1)}, nulls > 0),
            _issue(f"NEGATIVE_VALUES_{upper}", "error", F.col(f"{role}__negative"), {}, F.col(f"{role}__negative") > 0),
            _issue(
                f"HIGH_VALUES_{upper}", "warning", F.col(f"{role}__high"),
                {"max_expected": F.lit(UPPER_LIMITS[role]), "max_found": F.col(f"{role}__max")}, F.col(f"{role}__high") > 0,
            ),
            _issue(f"HIGH_ZERO_RATIO_{upper}", "info", zeros, {"pct": F.round(zero_pct, 1)}, zero_pct > 30),
        ]
    found = one.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")
    return static.unionByName(found)


def severity_counts(issues: DataFrame) -> DataFrame:
    """Findings by severity and whether the data passed (no error)."""
    counts = issues.agg(
        *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("error", "warning", "info")]
    )
    return counts.withColumn("is_valid", F.col("error_count") == 0)


def statistics(df: DataFrame) -> DataFrame:
    """Mean, median, deviation, minimum and maximum per workload column."""
    roles = value_columns(df)
    pairs = ", ".join(f"'{role}', cast(`{c}` as double)" for role, c in roles.items())
    long = df.select(F.expr(f"stack({len(roles)}, {pairs}) as (column, value)"))
    plain = long.groupBy("column").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    # Spark's own median would keep every distinct value of a column in one task.
    medians = quantiles.exact_quantiles(long, ["column"], "value", {"median": 0.5}).select("column", "median")
    return plain.join(medians, "column", "left").select("column", "mean", "median", "std", "min", "max")


def offending_rows(df: DataFrame, rules: dict[str, Column], order: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` rows in ``order`` that break each rule.

    Only ``k`` rows per rule and task leave the map side: Spark limits ranked
    groups before the exchange.
    """
    broken = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))
    tagged = df.withColumn("code", F.explode(broken))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(*order))
    return tagged.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Second and later rows of equal ``keys``; ``order`` is unique within a key.

    The first row of each key comes from a map-side aggregation. The join back is
    between many rows and one per key, so a key with very many copies is a plain
    skewed join side, which adaptive execution splits; nothing sorts a group.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = first.filter("_n > 1").drop("_n")
    return df.join(repeated, keys).filter(F.struct(*order) != F.col("_first")).drop("_first")
