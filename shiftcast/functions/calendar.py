"""German and Bavarian holidays and retail events, generated from rules.

Tables hold about fifteen rows per year, so their size is bounded by the span
of years and broadcasting them is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def with_easter(df: DataFrame, year: str = "y", name: str = "easter") -> DataFrame:
    """Adds Gregorian Easter Sunday by the anonymous (Meeus/Jones/Butcher) algorithm.

    Each intermediate is its own column, so that Catalyst keeps the steps apart
    instead of expanding them into one expression that repeats them.
    """

    def div(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    c = F.col
    steps = [
        {"_a": c(year) % 19, "_b": div(c(year), 100), "_c": c(year) % 100},
        {"_g": div(8 * c("_b") + 13, 25), "_d": div(c("_b"), 4), "_e": c("_b") % 4},
        {"_h": (19 * c("_a") + c("_b") - c("_d") - c("_g") + 15) % 30, "_i": div(c("_c"), 4), "_k": c("_c") % 4},
        {"_m": (32 + 2 * c("_e") + 2 * c("_i") - c("_h") - c("_k")) % 7},
        {"_n": div(c("_a") + 11 * c("_h") + 22 * c("_m"), 451)},
        {"_p": c("_h") + c("_m") - 7 * c("_n") + 114},
        {name: F.make_date(c(year), div(c("_p"), 31), c("_p") % 31 + 1)},
    ]
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, name)


# Holidays at a set month and day. The third field is the first
# year in which the day is a holiday, the fourth marks the Bavarian additions.
FIXED_DAYS = (
    ((1, 1), "New Year", 0, False),
    ((1, 6), "Epiphany", 0, True),
    ((5, 1), "Labour Day", 0, False),
    ((8, 15), "Assumption Day", 0, True),
    ((10, 3), "German Unity Day", 1990, False),
    ((11, 1), "All Saints", 0, True),
    ((12, 25), "Christmas Day", 0, False),
    ((12, 26), "Second Christmas Day", 0, False),
)
# Holidays at a distance in days from Easter Sunday.
EASTER_DAYS = (
    (-2, "Good Friday", False),
    (1, "Easter Monday", False),
    (39, "Ascension Day", False),
    (50, "Whit Monday", False),
    (60, "Corpus Christi", True),
)


def _years(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("y"))


def years_between(span: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The years ``y`` that a one-row table of two dates or times spans."""
    return span.select(F.explode(F.sequence(F.year(lo), F.year(hi))).alias("y"))


def years_of(df: DataFrame, day: str = "date") -> DataFrame:
    """The years from the first to the last day of a table."""
    return years_between(df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")))


def _entry(day: Column, name: str) -> Column:
    return F.struct(day.alias("date"), F.lit(name).alias("name"))


def holidays(
    spark: SparkSession, first_year: int, last_year: int, bavaria: bool = True, assumption: bool = True
) -> DataFrame:
    """``(date, name)`` of every holiday in the years given, both ends included."""
    return holidays_in(_years(spark, first_year, last_year), bavaria, assumption)


def holidays_in(years: DataFrame, bavaria: bool = True, assumption: bool = True) -> DataFrame:
    """``(date, name)`` of every holiday of a table of years ``y``."""
    y, easter = F.col("y"), F.col("easter")
    rows = []
    for (month, day), name, since, regional in FIXED_DAYS:
        if regional and not bavaria or name == "Assumption Day" and not assumption:
            continue
        date = F.make_date(y, F.lit(month), F.lit(day))
        rows.append(_entry(F.when(y >= since, date), name))
    for offset, name, regional in EASTER_DAYS:
        if bavaria or not regional:
            rows.append(_entry(F.date_add(easter, offset), name))
    # Reformation Day was a nationwide holiday once, in 2017.
    rows.append(_entry(F.when(y == 2017, F.make_date(y, F.lit(10), F.lit(31))), "Reformation Day"))
    # Repentance Day (Wednesday before 23 November) was nationwide until 1994.
    repentance = F.next_day(F.make_date(y, F.lit(11), F.lit(15)), "Wed")
    rows.append(_entry(F.when((y >= 1990) & (y <= 1994), repentance), "Repentance Day"))
    return (
        with_easter(years)
        .select(F.explode(F.array(*rows)).alias("h"))
        .select("h.date", "h.name")
        .filter("date IS NOT NULL")
    )


def retail_events(
    spark: SparkSession, first_year: int, last_year: int, rule: str = "fourth_friday"
) -> DataFrame:
    """``(date, name)`` of the Black Friday weekend and the days before Christmas.

    ``fourth_friday`` takes the fourth Friday of November;
    ``after_thanksgiving`` the day after the fourth Thursday.
    """
    return retail_events_in(_years(spark, first_year, last_year), rule)


def retail_events_in(years: DataFrame, rule: str = "fourth_friday") -> DataFrame:
    """The retail events of a table of years ``y``."""
    october_end = F.make_date(F.col("y"), F.lit(10), F.lit(31))
    if rule == "fourth_friday":
        friday = F.date_add(F.next_day(october_end, "Fri"), 21)
    elif rule == "after_thanksgiving":
        friday = F.date_add(F.next_day(october_end, "Thu"), 22)
    else:
        raise ValueError(f"unknown rule {rule!r}")
    # Names of the four days from Black Friday on.
    weekend = ("Black Friday", "Black Saturday", "Cyber Monday Weekend", "Cyber Monday")
    named = [_entry(F.date_add(friday, i), n) for i, n in enumerate(weekend)]
    named += [
        _entry(F.make_date(F.col("y"), F.lit(12), F.lit(d)), "Pre-Christmas Peak")
        for d in range(15, 24)
    ]
    return (
        years
        .select(F.explode(F.array(*named)).alias("e"))
        .select("e.date", "e.name")
    )


def holiday_and_event_days(years: DataFrame) -> DataFrame:
    """Nationwide and Bavarian holidays followed by the retail events."""
    return holidays_in(years).unionByName(retail_events_in(years))
