"""Exact duplicates by progressive refinement: byte length, prefix hash, full hash.

A text can only have copies if another text has its length and, among those, its
first characters. The full hash is taken only where both hold, above the join that
finds this out. All three steps are aggregations that combine on the map side, so a
group of copies that holds a third of all rows reaches each shuffle as one row per
task. What is joined back to the rows is one row per group: a broadcast up to a
stated number of groups, so no text and no hot key is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .common import documents, query, text_of

#: Up to so many lengths, (length, prefix) groups or groups of copies go to the executors
#: as a broadcast, 60 bytes each at most.
BROADCAST_GROUPS = 500_000
KEYS = ["n_bytes", "prefix_hash"]


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join with one row per key: a broadcast up to BROADCAST_GROUPS, else a shuffle of the rows."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table, keys, how)


def _shared_prefixes(slim: DataFrame) -> DataFrame:
    """(n_bytes, prefix_hash, shared) of those that several rows have, written."""
    lengths = slim.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    same_length = persist_to_shared(lengths, "same-length")
    left = _looked_up(slim.select(*KEYS), same_length, ["n_bytes"], "left_semi")
    groups = left.groupBy(*KEYS).count().where("count > 1").select(*KEYS, F.lit(True).alias("shared"))
    return persist_to_shared(groups, "same-prefix")


def _refine(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digest_all: bool) -> DataFrame:
    """One row per input row: row (the input row), doc_id, digest, shared.

    ``digest`` is null where no other row has the length and prefix, unless ``digest_all``.
    Beyond BROADCAST_GROUPS shared prefixes every text is hashed instead, so that the
    join shuffles no text.
    """
    text = text_of(text_col)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.select(
        row,
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix_hash"),
    )
    shared = _shared_prefixes(persist_to_shared(tagged.select(*KEYS), "prefixes"))
    if shared.count() <= BROADCAST_GROUPS:
        met = tagged.join(F.broadcast(shared), KEYS, "left")
        digest = _digest(F.col("text")) if digest_all else F.when(F.col("shared"), _digest(F.col("text")))
        return met.select("row", "doc_id", digest.alias("digest"), F.col("shared").isNotNull().alias("shared"))
    return tagged.select("row", "doc_id", _digest(F.col("text")).alias("digest"), F.lit(True).alias("shared"))


def _groups(refined: DataFrame) -> DataFrame:
    """(digest, keep_id, n_kept, group_size) of the texts with copies, written.

    n_kept is the number of rows that have the text and the kept id.
    """
    per_id = refined.where("shared").groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    found = per_id.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("last"), F.sum("n").alias("group_size"))
    groups = found.where("group_size > 1").select(
        "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.n").alias("n_kept"), "group_size"
    )
    return persist_to_shared(groups, "copies")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with their groups; rows that share nothing never meet a shuffle."""
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "digest", "left")
    alone = rows.where("NOT shared")
    empty = [F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in groups.columns if c != "digest"]
    return rows.where("shared").join(groups, "digest", "left").unionByName(alone.select("*", *empty))


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 200,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical; null equals the empty text. Of equal texts the
    row with the largest doc_id is kept. ``digest`` is the SHA-256 of the text in hex,
    null for texts that the refinement finds alone unless ``digest_all``.

    A null doc_id is smaller than any other; if all of a group are null, keep_id is
    null and the rows are kept. Rows that repeat both doc_id and text count in
    ``group_size`` and share one verdict; ``drop_copies`` leaves one of them. An
    empty table gives an empty result; further columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    refined = _refine(slim, "doc_id", "text", prefix_chars, digest_all)
    refined = persist_to_shared(refined.select("doc_id", "digest", "shared"), "digests")
    joined = _with_groups(refined, _groups(refined))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("digest"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 200) -> DataFrame:
    """The input rows that ``mark_copies`` keeps, with all their columns.

    Of rows that repeat doc_id and text, one stays. Columns of any name pass through.
    Texts meet no shuffle up to BROADCAST_GROUPS groups of copies and one beyond.
    """
    refined = _refine(docs, id_col, text_col, prefix_chars, False)
    groups = _groups(refined)
    kept = _with_groups(refined, groups).where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not groups.where("n_kept > 1").isEmpty():
        again = F.coalesce("n_kept", F.lit(1)) > 1
        once = kept.where(again).dropDuplicates(["doc_id", "digest"])
        kept = kept.where(~again).unionByName(once)
    return kept.select("row.*")


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op1(spark, sf_dir):
    return mark_copies(documents(spark, sf_dir), digest_all=True).withColumnRenamed("digest", "text_sha256")
