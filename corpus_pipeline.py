"""The training-data pipeline over ``documents``: one operator after another.

Each stage works on all rows its predecessor kept. ``run`` writes the rows between the
stages to the shared folder, so a lost executor repeats one stage at most.

All stages take null and repeated ids, null, empty and very long texts and empty tables, and
pass columns of any name through, but for the last, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftcast.llm import bpe, exact_dedup, minhash, mixing, quality
from shiftcast.session import persist_to_shared


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, each row by itself; null and empty texts are too short."""
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, null below all others; of rows equal in both, one.

    A null text equals the empty one."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles.

    The least doc_id stays, null after all others; ties go by a hash of the text. A document
    without words is linked with nothing and stays."""
    return minhash.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as came in, shared out by weight; a document may come in two epochs.

    Null languages and sources are values of their own; a document without words is never drawn."""
    return mixing.mix(docs, mixing.production_plan())


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text of each row, repeated ones too; none of an empty text."""
    return bpe.encode(docs, bpe.word_vocabulary())


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", without_copies),
    ("minhash near-dedup", without_near_copies),
    ("source mixing", mixed),
    ("bpe encoding", encoded),
]

# Hash signatures and the tokenizer's merges are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for label, stage in STAGES[:-1]:
        docs = persist_to_shared(stage(spark, docs, sf_dir), label.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
