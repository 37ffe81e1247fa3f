"""Chat formatting: against its SQL on odd rows, and the way back from the formatted text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import compare
from shiftcast.llm import chat
from shiftcast.llm.common import SQL

SCHEMA = "conv_id long, turn long, role string, text string, part int, formatted string, said string"
ROWS = [
    (1, 1, "user", "a<|b"),
    (1, 0, "sys\ntem<|", None),
    (1, 2, "user", "<\\|x\\\\|<\\\\|"),
    (1, 3, "assistant", "é<|im_end|>\n"),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "😀<"),
    (2, 300, "assistant", "late"),
    (2, None, "user", "null first"),
    (2, -3, "user", "negative"),
    (2, 5, "user", "again"),
    (2, 5, "user", "again"),  # the row again
    (2, 5, "assistant", "a tie"),
    (3, None, "user", "only"),
    (4, 0, None, "no role"),
    (None, 0, "assistant", "no id"),
    (None, None, None, None),
    (5, 0, "assistant", "long " * 100_000),
    (6, 0, "user", " \n<|im_sep|><|nl|>\\"),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, 0, "?", "?") for r in ROWS], SCHEMA)


def test_odd_rows_equal_sql(turns):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    assert compare(chat.digests(chat.with_control(turns)), con, SQL["op11_chat_format"]) == ""


def test_turns_come_back(turns):
    parts = chat.format_conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted")))
    back = {}
    order = lambda r: (r["part"] is not None, r["part"] or 0)
    for r in sorted(parts.collect(), key=order):
        back.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
    said = {}
    for conv, _, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        said.setdefault(conv, []).append((role or "", text or ""))
    assert back == said


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    (found,) = chat.format_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert found["formatted"] == (
        "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    )
    ((start, length),) = found["loss_spans"]
    assert found["formatted"][start : start + length] == "c"


def test_parts_hold_all_turns_of_a_hot_conversation(spark):
    """Nine of ten rows are one conversation; it spreads over parts, and the digests do not notice."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-7).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("t<|"), "id").alias("text"),
    )
    sizes = chat.format_conversations(rows).where("conv_id = -7").select(F.size(chat.read_turns(F.col("formatted")))).collect()
    assert len(sizes) == 16 and max(s[0] for s in sizes) <= chat.PART_TURNS
    assert sorted(chat.digests(rows).drop("formatted_chars").collect()) == sorted(
        chat.digests(rows, part_turns=10_000).drop("formatted_chars").collect()
    )


def test_nothing_of_nothing(turns):
    assert chat.format_conversations(turns.where("false")).collect() == []
    assert chat.digests(turns.where("false")).collect() == []


def test_control_conversation_comes_back(turns):
    found = chat.digests(chat.with_control(turns)).where("conv_id = -1").collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in found] == [(2, len(chat.CONTROL))]
