"""Batches of base64-encoded CSV payloads, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import bind
from .files import UPLOAD_NAMES, parsed


# What takes the place of characters that must not split a record or a field: the escape itself and the
# record separator used here, and inside quotes also line breaks and both field separators.
ESCAPE, RECORD, QUOTE = "\x1d", "\x1e", "\x1f"
ANYWHERE = {ESCAPE: ESCAPE + "0", RECORD: ESCAPE + "1", QUOTE: ESCAPE + "2"}
INSIDE = {"\n": ESCAPE + "3", ";": ESCAPE + "4", ",": ESCAPE + "5", "\r": ESCAPE + "6"}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    for old, new in table.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _records(text: Column) -> Column:
    """The records of a CSV text, in which every character between quotes is protected.

    The pieces between quotes lie inside and outside by turns, so whether a line break or a
    separator splits follows from the number of quotes before it. An empty piece outside
    is a doubled quote. A text with an odd number of quotes has no quoting at all.
    """

    def unquoted(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(RECORD))

    def joined(pieces: Column, last: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            framed = F.concat(F.when(k > 0, QUOTE).otherwise(""), unquoted(p), F.when(k < last, QUOTE).otherwise(""))
            doubled = (p == "") & (k > 0) & (k < last)
            return F.when(k % 2 == 1, _replaced(p, INSIDE)).when(doubled, '"').otherwise(framed)

        plain = F.array_join(F.transform(pieces, unquoted), '"')
        return F.when(last % 2 == 0, F.array_join(F.transform(pieces, piece), "")).otherwise(plain)

    # Bound values, as those of a lambda are evaluated anew for every piece.
    whole = bind(F.split(_replaced(text, ANYWHERE), '"'), lambda pieces: bind(F.size(pieces) - 1, lambda last: joined(pieces, last)))
    return F.filter(F.split(whole, RECORD), lambda x: F.trim(x) != "")


def _fields(record: Column, sep: Column) -> Column:
    """The fields of a record; those in quotes lose them and the blanks around them."""
    marks = {QUOTE: "", **{new: old for old, new in [*INSIDE.items(), *reversed(ANYWHERE.items())]}}

    def plain(field: Column) -> Column:
        inner = F.when(F.contains(field, F.lit(QUOTE)), F.trim(field)).otherwise(field)
        return _replaced(inner, marks)

    return F.transform(F.split(record, sep), plain)


def decode(payloads: DataFrame) -> DataFrame:
    """``(name, type, sep, columns, lines, error)`` of ``(name, type, content)``; a line is an array of fields.

    A payload that is no base64 or no table of at least one line carries an
    error code instead of rows. A line break between quotes belongs to its field.
    """
    text = F.try_to_binary("content", F.lit("base64")).cast("string")

    def table(text: Column, records: Column) -> Column:
        error = (
            F.when(text.isNull(), "NOT_BASE64")
            .when(F.size(records) == 0, "EMPTY_FILE")
            .when(~F.lower("name").endswith(".csv"), "UNSUPPORTED_FORMAT")
        )
        sep = F.when(F.contains(F.get(records, F.lit(0)), F.lit(";")), F.lit(";")).otherwise(F.lit(","))
        return bind(F.struct(error.alias("error"), sep.alias("sep")), lambda known: split_up(records, known))

    def split_up(records: Column, known: Column) -> Column:
        good, sep = known["error"].isNull(), known["sep"]
        rest = F.slice(records, F.lit(2), F.greatest(F.size(records) - 1, F.lit(0)))
        names = F.transform(_fields(F.get(records, F.lit(0)), sep), lambda c: F.regexp_replace(F.lower(F.trim(c)), " ", "_"))
        return F.struct(
            known["error"].alias("error"), F.when(good, sep).alias("sep"), F.when(good, names).alias("columns"),
            F.when(good, F.transform(rest, lambda r: _fields(r, sep))).alias("lines"),
        )

    whole = bind(text, lambda t: bind(_records(t), lambda records: table(t, records)))
    # As the one row of a generator a file is taken apart once: no filter on the result, as that
    # of a later explode, goes below it and does so again, in the end for each of its lines.
    apart = payloads.select("name", "type", F.explode(F.array(whole)).alias("_file"))
    return apart.select("name", "type", "_file.*")


#: Lines whose values tell a time column where no name does.
SAMPLE_LINES = 10


def _time_column() -> Column:
    """The first column whose values in the first lines all read as times, null values aside."""
    sample = F.slice("lines", 1, SAMPLE_LINES)

    def reads(k: Column) -> Column:
        values = F.filter(F.transform(sample, lambda line: F.get(line, k)), lambda v: F.coalesce(F.trim(v), F.lit("")) != "")
        return (F.size(values) > 0) & F.forall(values, lambda v: parsed(v).isNotNull())

    positions = F.sequence(F.lit(0), F.size("columns") - 1)
    return F.get("columns", F.get(F.filter(positions, reads), F.lit(0)))


def summarise(decoded: DataFrame) -> DataFrame:
    """Rows, columns and detected roles per file.

    Roles go by column name; a file without a time column by name has the first whose
    first values all read as times.
    """
    def column_of(names: tuple[str, ...]) -> Column:
        known = F.array(*[F.lit(n) for n in names])
        return F.get(F.filter(known, lambda n: F.array_contains(F.col("columns"), n)), F.lit(0))

    named = {role: column_of(names) for role, names in UPLOAD_NAMES.items()}
    named["timestamp"] = F.coalesce(named["timestamp"], _time_column())
    entries = [x for role, name in named.items() for x in (F.lit(role), name)]
    roles = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
    good = F.col("error").isNull()
    return decoded.select(
        "name", "type", good.alias("success"), "error",
        F.when(good, F.size("lines")).alias("rows"), "columns", F.when(good, roles).alias("column_mapping"),
    )


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count(F.lit(1)).alias("total_files"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def rows(decoded: DataFrame) -> DataFrame:
    """``(name, type, values)``: one map of column to text per line.

    A short line has NULL in its last columns; what a long one has more is left out.
    """
    lines = decoded.filter("error IS NULL").select("name", "type", "columns", F.explode("lines").alias("_f"))
    padded = F.transform("columns", lambda _, i: F.get("_f", i))
    return lines.select("name", "type", F.map_from_arrays("columns", padded).alias("values"))
