"""Python-side helpers of the operators that run over Arrow batches of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Rows that go to Python at once. Texts may be long, so this is far below Spark's default.
BATCH_ROWS = 500
#: Characters that an operator works on at once, unless one text alone is longer.
CHUNK_CHARS = 2_000_000


def slim_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def map_documents(docs: DataFrame, work, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``work`` over (doc_id, text) frames; a null text arrives as the empty one.

    doc_id arrives and leaves as it is, nulls included, so it must be an integer.
    The batch size of the session is lowered for it: it bounds the workers' memory.
    """
    return map_frames(slim_documents(docs, id_col, text_col), work, schema)


def map_frames(rows: DataFrame, work, schema: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    return rows.mapInPandas(work, schema)


def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of documents that together have about CHUNK_CHARS characters at most."""
    for frame in frames:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            if held >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def id_series(ids: list) -> pd.Series:
    return pd.Series(ids, dtype="Int64")


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    k = 0
    while a[k] == b[k]:
        k += 1
    return k
