"""What the operators share: column helpers and the catalog of queries.

All operators read only the columns they are told to read, by name, and return
columns of their own. Further input columns, also those whose names equal output
columns, are ignored unless an operator says that it passes rows through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: A word: a longest run without these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where there is one, the SQL that checks it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: str) -> Column:
    """Array of the words of a text; empty for null."""
    spaced = F.translate(text_of(column), SPACES[1:], " " * 5)
    return F.array_remove(F.split(spaced, " "), "")  # one literal character: no regular expression runs


def unsigned_hash(*columns) -> Column:
    """A hash from 0 to 2^32 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 32)
