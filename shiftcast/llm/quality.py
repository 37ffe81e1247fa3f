"""Quality rules as a short-circuit cascade.

Every rule is a condition on measures of the text, built from SQL functions. Its
cost and its share of rejected rows are estimated on a bounded sample; the rules
then run in the order of rejections per cost inside one CASE, so that a row that a
cheap rule rejects never reaches a dear one. The order changes the time only: the
verdict is that of all rules together. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .common import SPACES, documents, query, text_of, words_of

#: Measures that the result shows.
SHOWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Bounds of the sample that estimates cost and selectivity. Longer texts are left
#: out of the sample, never out of the verdicts.
SAMPLE_ROWS = 300
SAMPLE_BYTES = 100_000
#: Each sampled row is measured so often, to stand out from the cost of a job.
REPEATS = 6


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often it is mentioned."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _joined(hashes: Column, step: int) -> Column:
    """Hashes of runs twice as long, from those at i and i + step."""

    def join(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    return bind(hashes, join)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice: sort by hash, keep those with an
    equal neighbour, sort by position and add up the steps between them."""

    def repeated(s: Column) -> Column:
        def twin(x, j):
            before = F.when(j > 0, s[j - 1]["h"] == x["h"])
            after = F.when(j < F.size(s) - 1, s[j + 1]["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def total(p: Column) -> Column:
        n = F.size(p) - 1
        steps = F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return bind(bind(placed, repeated), total)


def count_repeated(column: str) -> Column:
    """Words in windows of eight words found twice or more; 64-bit hashes stand for windows."""
    hashes = F.transform(words_of(column), lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = _joined(hashes, step)
    distinct = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return bind(hashes, lambda w: F.when(distinct(w), 0).otherwise(_covered(w))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "")


def measures(column: str) -> dict[str, Column]:
    """What the rules look at, as expressions over the text column; null counts as empty."""
    text = text_of(column)
    lines = _lines(text)
    return {
        "n_words": F.size(words_of(column)).cast("long"),
        "word_chars": F.length(without(text, SPACES)).cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": count_repeated(column),
        "n_lines": F.size(lines).cast("long"),
        "n_capitals": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[dict[str, Column]], Column]


BASE = [
    Rule("short", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
]
FURTHER = [
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 40 * m["n_lines"]),
    Rule("capitals", lambda m: 100 * m["n_capitals"] > 30 * m["word_chars"]),
    Rule(
        "word_length",
        lambda m: (2 * m["word_chars"] < 5 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    ),
]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def estimate(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> list[Estimate]:
    """Cost and share of rejections of each rule on a sample, the worthiest first.

    Without any row to sample the rules keep their order. Ties keep it too. The sample is
    written to the shared folder; the texts do not pass the driver.
    """
    text = text_of(text_col)
    short = docs.select(text.alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    # A hash chooses among all rows, whatever their order; more than four times the number never comes.
    one_in = max(1, docs.count() // SAMPLE_ROWS)
    chosen = short.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).limit(4 * SAMPLE_ROWS)
    rows = persist_to_shared(chosen, "quality-sample")
    if rows.isEmpty():
        return [Estimate(r, 1.0, 0.0) for r in rules]
    sample = rows.select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("n"))
    found = measures("text")

    def timed(condition: Column) -> tuple[float, float]:
        begin = time.perf_counter()
        share = sample.agg(F.avg(condition.cast("int"))).first()[0]
        return time.perf_counter() - begin, share

    plain = F.length("text") < 0
    timed(plain)
    base = min(timed(plain)[0], timed(plain)[0])
    out = []
    for rule in rules:
        timed(rule.rejects(found))  # compiles it
        seconds, share = timed(rule.rejects(found))
        out.append(Estimate(rule, max(seconds - base, 1e-3), share))
    return sorted(out, key=lambda e: -e.worth)


def cascade(rules: list[Rule], found: dict[str, Column]) -> Column:
    """True where a rule rejects; later rules are evaluated only where earlier ones pass."""
    out = F.lit(False)
    for rule in reversed(rules):
        out = F.when(rule.rejects(found), True).otherwise(out)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measures of SHOWN, base_failed, kept.

    A null or empty text has no words, so it fails the base rules. Rows that repeat
    a doc_id are judged one by one; a null doc_id stays null; an empty table gives
    an empty result.
    """
    order = [e.rule for e in estimate(docs, FURTHER, text_col)]
    slim = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    whole = measures("text")
    # Columns of the result are measured in every row; what only the further rules read stays inside their CASE.
    found = slim.select("doc_id", "text", *[whole[k].alias(k) for k in SHOWN])
    m = whole | {k: F.col(k) for k in SHOWN}
    failed = BASE[0].rejects(m) | BASE[1].rejects(m)
    return found.select(
        "doc_id",
        *SHOWN,
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(~cascade(order, m)).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, with all their columns. One pass, no shuffle.

    A null or empty text is too short. Rows are judged one by one, whatever they repeat;
    columns of any name pass through; an empty table gives an empty result.
    """
    order = [e.rule for e in estimate(docs, rules or BASE + FURTHER, text_col)]
    return docs.where(~cascade(order, measures(text_col)))


_COUNTS = ", ".join(SHOWN)


@query(
    "op6_quality_rules",
    rf"""
    WITH parts AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
        FROM documents
    ), starts AS (
        SELECT doc_id, unnest(range(1, len(words) - 6)) AS i,
               unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS run
        FROM parts
    ), windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM starts
    ), repeated AS (
        SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM windows WHERE n > 1) GROUP BY doc_id
    ), measured AS (
        SELECT doc_id, len(words) AS n_words,
               coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
               length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_capitals
        FROM parts LEFT JOIN repeated USING (doc_id)
    ), based AS (
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
    )
    SELECT doc_id, {_COUNTS}, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
                OR 100 * n_capitals > 30 * word_chars OR 2 * word_chars < 5 * n_words
                OR word_chars > 12 * n_words) AS kept
    FROM based
    """,
)
def op6(spark, sf_dir):
    return judge(documents(spark, sf_dir)).select(
        "doc_id", *_COUNTS.split(", "), "base_failed", "kept"
    )
