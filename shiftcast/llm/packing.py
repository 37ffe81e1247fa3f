"""Packs token ids into rows of fixed width by best-fit decreasing.

Documents are cut into pieces of at most the row width; whole-width pieces are rows of
their own, the rest of each document is packed. Packing runs inside each task over
groups of a bounded number of pieces: sorted by length, each piece goes into the row
with the least room that still holds it, found by descent in a segment tree over room
sizes. With thousands of pieces to a group the waste of the last rows is negligible,
no text or token is shuffled, and a lost task repeats its own rows only.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import chunks, map_documents
from .common import documents, query

GROUP_PIECES = 4096

class RoomTree:
    """A segment tree over room sizes 0..width: which sizes some open row has."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room that is at least ``need``, and that room."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: nothing to its right below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.any[2 * node])
        room = node - self.leaves
        row = self.rows[room].pop()
        while node and not (self.rows[room] if node >= self.leaves else self.any[2 * node] | self.any[2 * node + 1]):
            self.any[node] = 0
            node >>= 1
        return row, room


def best_fit(lengths: list[int], width: int) -> list[int]:
    """The row of each piece, by best-fit decreasing; ties in the order given."""
    tree, out, rows = RoomTree(width), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = rows, width
            rows += 1
        out[i] = found[0]
        tree.put(found[0], found[1] - lengths[i])
    return out


def tokenizer(vocabulary: str, pattern: str):
    """A byte-level tokenizer from a file of ranks; strings of special tokens are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Row:
    width: int
    ids: list[np.ndarray] = field(default_factory=list)
    doc_ids: list = field(default_factory=list)
    starts: list[int] = field(default_factory=list)

    def add(self, doc_id, start: int, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
        self.starts.append(start)

    def record(self, pack_id: int, pad: int, kind: np.dtype) -> dict:
        ends = np.cumsum([len(x) for x in self.ids])
        line = np.full(self.width, pad, kind)
        line[: ends[-1]] = np.concatenate(self.ids)
        return {
            "pack_id": pack_id,
            "n_tokens": int(ends[-1]),
            "ids": line.tobytes(),
            "cu_seqlens": [0, *ends.tolist()],
            "position_resets": [0, *ends[:-1].tolist()],
            "doc_ids": self.doc_ids,
            "starts": self.starts,
        }


SCHEMA = (
    "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, starts array<long>"
)


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    width: int = 2048,
    end_id: int = 50256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per packed row of ``width`` ids.

    ids holds them as little-endian unsigned integers, of 2 bytes if every id of the
    vocabulary fits and else 4, padded with ``end_id``; cu_seqlens has the borders of
    the segments (the last is n_tokens), position_resets where position ids restart at
    0, doc_ids the document of each segment and starts its offset in the document's
    ids. Each document's ids end with ``end_id``, so a null or empty text is one token.
    Repeated rows are packed one by one; a null doc_id stays null; an empty table gives
    an empty result. pack_id is unique; which rows share one depends on how Spark
    splits the input.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(vocabulary, pattern)
        kind = np.dtype("<u2" if max(encoder.n_vocab, end_id + 1) <= 1 << 16 else "<u4")
        base, made = TaskContext.get().partitionId() << 40, 0
        rest: list[tuple] = []

        def frame(rows: list[Row]) -> pd.DataFrame:
            nonlocal made
            made += len(rows)
            return pd.DataFrame([r.record(base + made - len(rows) + i, end_id, kind) for i, r in enumerate(rows)])

        def packed() -> list[Row]:
            where = best_fit([len(ids) for _, _, ids in rest], width)
            rows = [Row(width) for _ in range(max(where) + 1)]
            for row, piece in zip(where, rest):
                rows[row].add(*piece)
            rest.clear()
            return rows

        for doc_ids, texts in chunks(frames):
            full: list[Row] = []
            for doc_id, text in zip(doc_ids, texts):
                found = encoder.encode_to_numpy(text, disallowed_special=())
                ids = np.append(found.astype(kind), kind.type(end_id))
                for start in range(0, len(ids), width):
                    piece = ids[start : start + width]
                    if len(piece) == width:
                        full.append(Row(width))
                        full[-1].add(doc_id, start, piece)
                    else:
                        rest.append((doc_id, start, piece))
                if len(rest) >= GROUP_PIECES:
                    yield frame(packed())
                if len(full) >= GROUP_PIECES:
                    yield frame(full)
                    full = []
            if full:
                yield frame(full)
        if rest:
            yield frame(packed())

    return map_documents(docs, work, SCHEMA, id_col, text_col)


def write_matrices(packed: DataFrame, path: str, rows: int = 256, width: int = 2048) -> None:
    """Writes matrices of up to ``rows`` packed rows as Parquet, one matrix per record.

    ids is the matrix in row order; cu_seqlens runs over the whole matrix without the
    padding; position_ids has the positions of all its cells (0 in the padding).
    """
    schema = "matrix_id long, n_rows int, ids binary, cu_seqlens array<int>, position_ids binary"

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), rows):
                part = frame.iloc[at : at + rows]
                cu, lines = [0], []
                for borders in part["cu_seqlens"]:
                    cu += [cu[-1] + int(b) for b in np.diff(borders).cumsum()]
                    lines.append(position_ids(borders, width))
                yield pd.DataFrame(
                    {
                        "matrix_id": [part["pack_id"].iloc[0]],
                        "n_rows": [len(part)],
                        "ids": [b"".join(part["ids"])],
                        "cu_seqlens": [cu],
                        "position_ids": [np.concatenate(lines).astype("<u4").tobytes()],
                    }
                )

    packed.select("pack_id", "ids", "cu_seqlens").mapInPandas(work, schema).write.parquet(path)


def position_ids(borders, width: int) -> np.ndarray:
    """Positions 0, 1, ... of each segment of a row, then zeros up to the row's width."""
    borders = np.asarray(borders)
    used = np.arange(borders[-1]) - np.repeat(borders[:-1], np.diff(borders))
    return np.pad(used, (0, width - borders[-1]))


def byte_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op3_packed_token_ids")
def op3(spark, sf_dir):
    """Packed rows with the digest of their ids in place of the ids."""
    return pack(documents(spark, sf_dir), *byte_vocabulary()).select(
        "pack_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        "cu_seqlens",
        "position_resets",
        "doc_ids",
        "starts",
    )
