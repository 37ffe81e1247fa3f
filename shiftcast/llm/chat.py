"""Conversations as training text, by relational formatting in Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role become one block, and the blocks are concatenated::

    <|im_start|>user
    first question<|im_sep|>second question<|im_end|>
    <|im_start|>assistant
    answer<|im_end|>

Inside texts and roles a backslash goes between ``<`` and ``|``; where backslashes stand
there already, one more. So no text holds ``<|``, only the template's own strings do, and
taking one backslash away gives the text back. A line break in a role is ``<|nl|>``.

A conversation is formatted in parts of ``part_turns`` turn numbers, each a row of its own,
so that one of very many turns spreads over many tasks. One shuffle of the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import query

# The control strings of the template.
START, END, SEPARATOR, BREAK = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"

#: Turn numbers of a part.
PART_TURNS = 256
#: Up to so many conversations of several parts are told apart by a broadcast, 8 bytes each.
BROADCAST_LONG = 500_000


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn_from: tuple[str, ...] = ("assistant",),
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """One row per part of a conversation: conv_id, part, formatted, loss_spans.

    ``loss_spans`` are the (start, length) in code points, from 0, of each text of the
    roles ``learn_from``, without the control strings around it. A part holds the turns
    whose number divided by ``part_turns`` gives ``part``; blocks end with their part.

    Turns are ordered by number, then role, then text; a null number comes first, in a
    part of its own with a null ``part``. A null text or role counts as empty, an empty
    text is a turn. Repeated rows are repeated turns. Null conv_ids are one conversation.
    Further columns are ignored, an empty table gives an empty result. A part is one value,
    so its turns must have less than 2 GB of text.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        part_of(F.col(turn_col), part_turns).alias("part"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("said"),
    )
    sorted_turns = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    return (
        sorted_turns.withColumn("blocks", _merge_adjacent(F.col("turns")))
        .withColumn("pieces", F.flatten(F.transform("blocks", lambda b: _pieces(b, learn_from))))
        .select(
            "conv_id",
            "part",
            F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
            _spans(F.col("pieces")).alias("loss_spans"),
        )
    )


def part_of(turn: Column, part_turns: int) -> Column:
    return F.floor(turn / part_turns)


def _merge_adjacent(turns: Column) -> Column:
    """array<role, texts> of sorted turns: a block begins where the role changes."""
    positions = F.sequence(F.lit(1), F.size(turns))
    begins = F.filter(
        positions,
        lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]),
    )
    ranges = F.arrays_zip(
        begins.alias("begin"), F.array_append(F.slice(begins, 2, F.size(begins)), F.size(turns) + 1).alias("after")
    )
    return F.transform(
        ranges,
        lambda r: F.struct(
            F.get(turns, r["begin"] - 1)["role"].alias("role"),
            F.transform(F.slice(turns, r["begin"], r["after"] - r["begin"]), lambda t: t["text"]).alias("texts"),
        ),
    )


def _pieces(block: Column, learn_from: tuple[str, ...]) -> Column:
    """array<text, loss> of a block; its pieces joined are the formatted block."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    no = F.lit(False)
    header = F.concat(F.lit(START), F.replace(escape(block["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    texts = F.transform(
        block["texts"],
        lambda text, k: F.array(
            piece(F.when(k == 0, header).otherwise(F.lit(SEPARATOR)), no),
            piece(escape(text), block["role"].isin(*learn_from)),
        ),
    )
    return F.array_append(F.flatten(texts), piece(F.lit(END), no))


def _spans(pieces: Column) -> Column:
    """Where the pieces with a loss lie in the joined text."""
    nothing = F.struct(
        F.lit(0).cast("long").alias("chars"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    def step(state: Column, piece: Column) -> Column:
        n = F.length(piece["text"]).cast("long")
        span = F.struct(state["chars"].alias("start"), n.alias("length"))
        return F.struct(
            (state["chars"] + n).alias("chars"),
            F.when(piece["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return F.aggregate(pieces, nothing, step, lambda state: state["spans"])


def read_turns(formatted: Column) -> Column:
    """array<role, text> of the turns of a formatted part, in order: the way back."""
    blocks = F.filter(F.split(formatted, _literal(END)), lambda b: b != "")  # nothing follows the last end
    named = F.transform(
        blocks,
        lambda b: F.struct(
            F.substring_index(b, "\n", 1).alias("header"),
            b.alias("block"),
        ),
    )

    def turns(b: Column) -> Column:
        role = F.replace(F.replace(b["header"], F.lit(START), F.lit("")), F.lit(BREAK), F.lit("\n"))
        said = F.substring(b["block"], F.length(b["header"]) + 2, F.length(b["block"]))
        return F.transform(
            F.split(said, _literal(SEPARATOR)),
            lambda text: F.struct(unescape(role).alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(named, turns))


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )


# Fixed value: what both rows of conversation -1 say.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _read_back(parts: DataFrame) -> DataFrame:
    turns = parts.withColumn("turns", read_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(lines, "").alias("said"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def digests(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, read back from its formatted parts: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Only conversations of several parts are put together by a second shuffle. A digest
    covers a whole conversation, so that text is one value here.
    """
    slim = turns.select("conv_id", "turn", "role", "text")
    beyond = F.coalesce(part_of(F.col("turn"), part_turns), F.lit(-1)) != 0
    several = slim.where(beyond).select(F.col("conv_id").alias("long_id")).distinct()
    if several.count() <= BROADCAST_LONG:
        several = F.broadcast(several)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = _read_back(format_conversations(slim.join(several, is_long, "left_anti"), part_turns=part_turns))
    parts = _read_back(format_conversations(slim.join(several, is_long, "left_semi"), part_turns=part_turns))
    ordered = F.sort_array(F.collect_list(F.struct("part", "said", "learned")))
    whole = parts.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        ordered.alias("parts"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    whole = whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("parts", lambda p: p["said"]), "").alias("said"),
        F.array_join(F.transform("parts", lambda p: p["learned"]), "").alias("learned"),
        "formatted_chars",
    )
    return short.select(*whole.columns).unionByName(whole).select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts hold control strings."""
    spark = turns.sparkSession
    said = [F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(["user", "assistant"])]
    control = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*said)).alias("s"))
    control = control.select("conv_id", F.col("s.turn").cast("long").alias("turn"), "s.role", F.lit(CONTROL).alias("text"))
    numbered = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return numbered.unionByName(control)


@query(
    "op11_chat_format",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ), marked AS (
        SELECT *, floor(turn / 256) AS part,
               length(text) + len(regexp_extract_all(text, '<\\*\|')) AS text_chars,
               length(role) + len(regexp_extract_all(role, '<\\*\|')) + 5 * len(regexp_extract_all(role, '\n')) AS role_chars,
               role IS DISTINCT FROM lag(role) OVER (
                   PARTITION BY conv_id, floor(turn / 256) ORDER BY turn NULLS FIRST, role, text) AS begins
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                           FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(text_chars + CASE WHEN begins THEN 12 + role_chars + 1 + 11 ELSE 10 END)::BIGINT AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def op11(spark, sf_dir):
    return digests(with_control(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
