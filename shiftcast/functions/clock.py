"""Calendar parts of TIMESTAMP_NTZ columns, independent of the session time zone.

``date_trunc`` turns a TIMESTAMP_NTZ into a zoned TIMESTAMP, so hour floors are
built from the date and the hour instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
GERMAN_DAY_NAMES = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def hours(n: Column | int) -> Column:
    """A day-time interval of ``n`` hours."""
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def hour_floor(ts: Column | str) -> Column:
    return F.to_date(_c(ts)).cast("timestamp_ntz") + hours(F.hour(_c(ts)))


def hour_index(ts: Column | str) -> Column:
    """Whole hours since 1970-01-01, so that lags are plain integer differences."""
    return (F.unix_date(F.to_date(_c(ts))) * 24 + F.hour(_c(ts))).cast("bigint")


def from_hour_index(index: Column | str) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.floor(_c(index) / 24).cast("int"), F.pmod(_c(index), F.lit(24)).cast("int")
    )


def epoch_micros(ts: Column | str) -> Column:
    c = _c(ts)
    whole = F.unix_date(F.to_date(c)).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return whole * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def as_instant(ts: Column | str) -> Column:
    """The TIMESTAMP whose UTC reading is the given TIMESTAMP_NTZ; watermarks need
    an instant, and this one does not depend on the session time zone."""
    return F.timestamp_micros(epoch_micros(ts))


def from_instant(ts: Column | str) -> Column:
    """Back to TIMESTAMP_NTZ, exact to the microsecond."""
    micros = F.unix_micros(_c(ts))
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    day = F.floor(micros / 86_400_000_000).cast("int")
    return ntz("1970-01-01 00:00:00") + F.make_dt_interval(day, secs=seconds - day.cast("decimal(18,0)") * 86400)


def weekday(ts: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ts))


def is_weekday(ts: Column | str) -> Column:
    return F.weekday(_c(ts)) < 5


def week_start(ts: Column | str) -> Column:
    return F.to_date(F.trunc(F.to_date(_c(ts)), "week"))


def month_start(ts: Column | str) -> Column:
    return F.to_date(F.trunc(F.to_date(_c(ts)), "month"))


def period_start(ts: Column | str, grain: str) -> Column:
    if grain == "day":
        return F.to_date(_c(ts))
    if grain == "week":
        return week_start(ts)
    if grain == "month":
        return month_start(ts)
    raise ValueError(f"unknown grain {grain!r}")


def iso_year(ts: Column | str) -> Column:
    return F.date_part(F.lit("YEAROFWEEK"), _c(ts)).cast("int")


def _name_of(ts: Column | str, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.weekday(_c(ts)) + 1)


def day_name(ts: Column | str) -> Column:
    return _name_of(ts, DAY_NAMES)


def german_day_name(ts: Column | str) -> Column:
    return _name_of(ts, GERMAN_DAY_NAMES)


def is_working_hour(ts: Column | str, start: int = 8, end: int = 20) -> Column:
    h = F.hour(_c(ts))
    return (h >= start) & (h < end)


def shift_label(ts: Column | str, length: int = 8, start: int = 8, end: int = 20) -> Column:
    """``HH:00-HH:00`` of the shift an hour belongs to, clipped at closing time."""
    number = F.floor((F.hour(_c(ts)) - start) / F.lit(length))
    first = (F.lit(start) + number * length).cast("int")
    return F.format_string("%02d:00-%02d:00", first, F.least(first + length, F.lit(end)))
