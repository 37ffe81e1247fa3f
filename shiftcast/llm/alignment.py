"""Alignment of two tokenizers over a corpus, by external spill counting.

Both tokenizers cut the same bytes. Where tokens of both end, the text falls into groups;
a token of A and a token of B are linked if their byte ranges share a group. How many
documents hold an (A id, B id) pair is counted over the corpus without a hash table of
all pairs:

1. **Spill.** A task buffers pair-document records. A full buffer is sorted side-major
   (A id, B id, document), cut into radix partitions by A id and written as zstd runs, one
   for each partition: the pairs with their number of documents, and apart from them the
   documents of each pair.
2. **Merge.** The runs of one radix partition meet in one task. A heap of the runs gives the
   A ids in order; the pairs of an A id are counted together, which also yields the highest
   count of that A id. Each run gets the counts of its own pairs back.
3. **Contributions.** The counts return to their spill, whose records turn them into the
   sums of each document.

The pairs of a spill are counted before anything is shuffled, so a pair that all documents
hold reaches its merge as one number per spill. All tables between the steps lie in the
shared folder or in Spark's shuffle. Python tasks hold one buffer, the runs of one radix
partition, or the sums of one spill.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .batches import chunks, id_series, map_documents, map_frames
from .bpe import byte_symbols
from .common import documents, query

#: Records that a task buffers before it spills them, unless one document has more.
SPILL_RECORDS = 4_000_000
#: Bits of a document's number within its spill.
DOC_BITS = 20
#: Links that are expanded at once.
LINKS_AT_ONCE = 4_000_000
#: One radix partition for so many documents, between these bounds.
DOCS_PER_RADIX, FEWEST_RADIXES, MOST_RADIXES = 32_768, 64, 2_048


class ByteTokens:
    """A byte-level tokenizer from its file; strings of special tokens are ordinary text."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        value = {symbol: byte for byte, symbol in byte_symbols().items()}
        ranks = {bytes(value[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """A sentence-piece tokenizer from its model; it puts a space before the text itself."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Tables:
    """What both vocabularies need in arrays: byte lengths, and ids as text with what follows them."""

    def __init__(self, a, b) -> None:
        self.a, self.b = a, b
        self.length_a = np.array([len(t) for t in a.bytes])
        self.length_b = np.array([len(t) for t in b.bytes])
        self.b_bits = int(len(b.bytes) - 1).bit_length()
        if int(len(a.bytes) - 1).bit_length() + self.b_bits + DOC_BITS > 63:
            raise ValueError("the vocabularies are too large")
        self.base = {(side, last): base for side, last, base in self._bases()}
        self.texts = [
            f"{k}{mark}"
            for side, marks in ((a, ",|"), (b, ",;"))
            for mark in marks
            for k in range(len(side.bytes))
        ]

    def _bases(self):
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        return [("a", False, 0), ("a", True, n_a), ("b", False, 2 * n_a), ("b", True, 2 * n_a + n_b)]


@cache
def tables(vocabulary_a: str, pattern_a: str, model_b: str) -> Tables:
    return Tables(ByteTokens(vocabulary_a, pattern_a), PieceTokens(model_b))


@dataclass
class Aligned:
    """Some documents: their numbers, and the records (key, links) of their pairs, sorted.

    A key is A id, B id and number of the document, from the highest bits to the lowest.
    """

    frame: pd.DataFrame
    keys: np.ndarray
    links: np.ndarray


def align(t: Tables, texts: list[str], first: int) -> Aligned:
    """Aligns texts whose numbers in the spill start at ``first``."""
    n = len(texts)
    out = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * n
    wanted = [k for k, text in enumerate(texts) if text]
    ids_a = t.a.encode([texts[k] for k in wanted])
    ids_b = t.b.encode([texts[k] for k in wanted])
    good = []
    for k, a, b in zip(wanted, ids_a, ids_b):
        raw = (" " + texts[k]).encode()
        if b"".join(map(t.a.bytes.__getitem__, a)) == raw and b"".join(map(t.b.bytes.__getitem__, b)) == raw:
            good.append((k, a, b, len(raw)))
    keys = links = np.zeros(0, np.int64)
    if good:
        docs = np.array([g[0] for g in good])
        flat_a = np.concatenate([np.array(g[1], np.int64) for g in good])
        flat_b = np.concatenate([np.array(g[2], np.int64) for g in good])
        doc_ends = np.cumsum([g[3] for g in good])
        ends_a, ends_b = np.cumsum(t.length_a[flat_a]), np.cumsum(t.length_b[flat_b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        p, q = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        doc_of = np.searchsorted(doc_ends, ends)  # the end of a document ends a group
        out["n_a"][docs] = [len(g[1]) for g in good]
        out["n_b"][docs] = [len(g[2]) for g in good]
        out["n_groups"][docs] = np.bincount(doc_of, minlength=len(docs))
        group_starts = np.concatenate([[0], np.flatnonzero(np.diff(doc_of)) + 1])
        out["n_links"][docs] = np.add.reduceat(p * q, group_starts)
        start_a, start_b = np.cumsum(p) - p, np.cumsum(q) - q
        _digest_groups(t, digests, docs, (flat_a, of_a, p, start_a), (flat_b, of_b, q, start_b), doc_ends, ends)
        keys, links = _records(t, (flat_a, p, start_a), (flat_b, q, start_b), docs[doc_of] + first)
    frame = pd.DataFrame(out | {"groups_sha256": digests, "number": np.arange(first, first + n)})
    return Aligned(frame, keys, links)


def _digest_groups(t: Tables, digests: list[str], docs, side_a, side_b, doc_ends, ends) -> None:
    (flat_a, of_a, p, start_a), (flat_b, of_b, q, start_b) = side_a, side_b
    last_a = np.zeros(len(flat_a), bool)
    last_a[start_a + p - 1] = True
    last_b = np.zeros(len(flat_b), bool)
    last_b[start_b + q - 1] = True
    code = np.empty(len(flat_a) + len(flat_b), np.int64)
    place_a = np.arange(len(flat_a)) + start_b[of_a]
    code[place_a] = flat_a + np.where(last_a, t.base["a", True], t.base["a", False])
    code[np.arange(len(flat_b)) + (start_a + p)[of_b]] = flat_b + np.where(last_b, t.base["b", True], t.base["b", False])
    tokens_until = (start_a + p + start_b + q)[np.searchsorted(ends, doc_ends)]
    begin = 0
    for doc, end in zip(docs, tokens_until):
        joined = "".join(map(t.texts.__getitem__, code[begin:end].tolist()))
        digests[doc] = hashlib.sha256(joined[:-1].encode()).hexdigest()
        begin = end


def _records(t: Tables, side_a, side_b, number_of) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the links of each, expanded in slices of bounded size."""
    (flat_a, p, start_a), (flat_b, q, start_b) = side_a, side_b
    found = []
    size = p * q
    small = np.flatnonzero(size <= LINKS_AT_ONCE)
    slices = np.searchsorted(np.cumsum(size[small]), np.arange(LINKS_AT_ONCE, size[small].sum(), LINKS_AT_ONCE))
    for groups in np.split(small, np.unique(slices)):
        if len(groups):
            n, rows = size[groups], q[groups]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(np.arange(len(groups)), n)
            a = flat_a[start_a[groups][of] + within // rows[of]]
            b = flat_b[start_b[groups][of] + within % rows[of]]
            found.append(_sum_links(_key(t, a, b, number_of[groups][of]), None))
    for g in np.flatnonzero(size > LINKS_AT_ONCE):  # by its distinct ids: links of a pair multiply
        a, n_a = np.unique(flat_a[start_a[g] : start_a[g] + p[g]], return_counts=True)
        b, n_b = np.unique(flat_b[start_b[g] : start_b[g] + q[g]], return_counts=True)
        step = max(1, LINKS_AT_ONCE // len(b))
        for k in range(0, len(a), step):
            some, n_some = a[k : k + step], n_a[k : k + step]
            key = _key(t, np.repeat(some, len(b)), np.tile(b, len(some)), number_of[g])
            found.append((key, np.outer(n_some, n_b).ravel()))
    if len(found) == 1:
        return found[0]
    return _sum_links(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def _key(t: Tables, a, b, number) -> np.ndarray:
    return (a << t.b_bits | b) << DOC_BITS | number


def _sum_links(keys: np.ndarray, links: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if links is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, links = keys[order], links[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if links is None:
        return keys[begins], np.diff(begins, append=len(keys))
    return keys[begins], np.add.reduceat(links, begins) if len(keys) else links


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers from 0 in their least width, as one zstd frame."""
    parts, head = [], []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype("u1")
        head.append((kind.str, len(x)))
        parts.append(x.astype(kind).tobytes())
    header = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(header).to_bytes(4, "little") + header + b"".join(parts))


def unpack(frame: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(frame)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += out[-1].size * np.dtype(kind).itemsize
    return out


@dataclass
class Spill:
    """The buffer of a task; ``number`` is unique among the task's spills."""

    number: int
    docs: int = 0
    records: int = 0
    held: list[Aligned] = field(default_factory=list)

    def add(self, part: Aligned) -> None:
        self.held.append(part)
        self.docs += len(part.frame)
        self.records += len(part.keys)

    def runs(self, b_bits: int, radixes: int) -> Iterator[dict]:
        keys = np.concatenate([h.keys for h in self.held])
        links = np.concatenate([h.links for h in self.held])
        # Side-major, radix partitions one after another; the parts are sorted runs already.
        radix = (keys >> (b_bits + DOC_BITS)) % radixes
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(radix[order].astype(np.uint16), kind="stable")]
        keys, links, radix = keys[order], links[order], radix[order]
        for one in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(radix)) + 1) if len(keys) else []:
            pairs, numbers = keys[one] >> DOC_BITS, keys[one] & ((1 << DOC_BITS) - 1)
            begins = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            n_docs = np.diff(begins, append=len(pairs))
            yield {
                "radix": int(radix[one[0]]),
                "run": pack(np.diff(pairs[begins], prepend=0), n_docs),
                "records": pack(n_docs, numbers, links[one]),
            }


SPILL_COLUMNS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "number long, spill long, radix int, run binary, records binary"
)


def merge_runs(runs: list[bytes], b_bits: int) -> Iterator[bytes]:
    """Counts of each run's pairs over all runs, and whether they are their A id's highest."""
    pairs, docs, cuts = [], [], []
    for run in runs:
        steps, n_docs = unpack(run)
        pairs.append(np.cumsum(steps))
        docs.append(n_docs)
        side = pairs[-1] >> b_bits
        cuts.append(np.concatenate([[0], np.flatnonzero(np.diff(side)) + 1, [len(side)]]))
    counts = [np.empty_like(d) for d in docs]
    best = [np.zeros(len(d), np.int64) for d in docs]
    heap = [(int(p[0] >> b_bits), k, 0) for k, p in enumerate(pairs) if len(p)]
    heapq.heapify(heap)
    while heap:
        side, met = heap[0][0], []
        while heap and heap[0][0] == side:
            _, k, j = heap[0]
            begin, end = cuts[k][j], cuts[k][j + 1]
            met.append((k, begin, end))
            if end < len(pairs[k]):
                heapq.heapreplace(heap, (int(pairs[k][end] >> b_bits), k, j + 1))
            else:
                heapq.heappop(heap)
        distinct, place = np.unique(np.concatenate([pairs[k][i:j] for k, i, j in met]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([docs[k][i:j] for k, i, j in met]))
        highest, at = total.max(), 0
        for k, i, j in met:
            counts[k][i:j] = total[place[at : at + j - i]]
            best[k][i:j] = counts[k][i:j] == highest
            at += j - i
    return (pack(c, b) for c, b in zip(counts, best))


def _merge(frames: Iterator[pd.DataFrame], b_bits: int) -> Iterator[pd.DataFrame]:
    """Rows (spill, radix, run) in the order of radix; the runs of one radix are merged at a time."""
    held, radix = [], None

    def merged():
        counts = list(merge_runs([run for _, run in held], b_bits))
        return pd.DataFrame({"spill": [s for s, _ in held], "radix": radix, "counts": counts})

    for frame in frames:
        for spill, at, run in zip(frame["spill"], frame["radix"], frame["run"]):
            if held and at != radix:
                yield merged()
                held = []
            radix = at
            held.append((spill, run))
    if held:
        yield merged()


def _contribute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (spill, radix, is_records, packed) in this order; sums of each document of a spill."""
    spill, counts, best = None, None, None
    sums = np.zeros((2, 0), np.int64)

    def documents_of_spill():
        number = np.flatnonzero(sums[0])
        return pd.DataFrame(
            {"spill": spill, "number": number, "count_sum": sums[0][number], "n_best": sums[1][number]}
        )

    for frame in frames:
        for at, is_records, packed in zip(frame["spill"], frame["is_records"], frame["packed"]):
            if spill is not None and at != spill:
                yield documents_of_spill()
                sums = np.zeros((2, 0), np.int64)
            spill = at
            if not is_records:
                counts, best = unpack(packed)
                continue
            n_docs, numbers, links = unpack(packed)
            most = int(numbers.max()) + 1
            if most > sums.shape[1]:
                sums = np.pad(sums, ((0, 0), (0, most - sums.shape[1])))
            np.add.at(sums[0], numbers, np.repeat(counts, n_docs) * links)
            np.add.at(sums[1], numbers, np.repeat(best, n_docs) * links)
    if spill is not None:
        yield documents_of_spill()


def align_documents(
    docs: DataFrame,
    vocabulary_a: str,
    pattern_a: str,
    model_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    radixes: int | None = None,
    spill_records: int = SPILL_RECORDS,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level, from a tokenizer file and its splitting pattern) encodes a space and the
    text, B (sentence pieces, from a model) the text, before which it puts a space itself.
    A pair's count is the number of rows that hold it linked. ``n_best`` counts the links
    whose count is the highest of their A id, ties included; ``count_sum`` sums the counts
    over the links. ``groups_sha256`` is the digest of the groups' ids.

    A null or empty text, or one that the tokens of A or B do not give back byte by byte,
    has zeros and an empty string. Repeated rows are documents of their own, null ids stay.
    Further columns are ignored, an empty table gives an empty result.
    """
    if radixes is None:
        radixes = min(MOST_RADIXES, max(FEWEST_RADIXES, docs.count() // DOCS_PER_RADIX))

    def spill_documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tables(vocabulary_a, pattern_a, model_b)
        names = [c.split()[0] for c in SPILL_COLUMNS.split(", ")]
        spill = Spill(TaskContext.get().partitionId() << 32)
        for ids, texts in chunks(frames):
            if spill.docs + len(texts) > 1 << DOC_BITS or spill.records >= spill_records:
                yield from _spilled(spill, t, radixes, names)
                spill = Spill(spill.number + 1)
            part = align(t, texts, spill.docs)
            spill.add(part)
            yield _columns(part.frame.assign(doc_id=id_series(ids), spill=spill.number), names)
        yield from _spilled(spill, t, radixes, names)

    spilled = persist_to_shared(map_documents(docs, spill_documents, SPILL_COLUMNS, id_col, text_col), "alignment")
    runs = spilled.where("radix IS NOT NULL")
    b_bits = tables(vocabulary_a, pattern_a, model_b).b_bits
    by_radix = runs.select("spill", "radix", "run").repartition("radix").sortWithinPartitions("radix")
    counts = map_frames(by_radix, lambda frames: _merge(frames, b_bits), "spill long, radix int, counts binary")
    parts = counts.select("spill", "radix", F.lit(False).alias("is_records"), F.col("counts").alias("packed")).unionByName(
        runs.select("spill", "radix", F.lit(True).alias("is_records"), F.col("records").alias("packed"))
    )
    by_spill = parts.repartition("spill").sortWithinPartitions("spill", "radix", "is_records")
    sums = map_frames(by_spill, _contribute, "spill long, number long, count_sum long, n_best long")
    found = spilled.where("radix IS NULL").join(sums, ["spill", "number"], "left")
    return found.select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )


def _spilled(spill: Spill, t: Tables, radixes: int, names: list[str]) -> Iterator[pd.DataFrame]:
    if spill.records:
        yield _columns(pd.DataFrame(list(spill.runs(t.b_bits, radixes))).assign(spill=spill.number), names)


def _columns(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """The named columns, null where the rows have none."""
    return pd.DataFrame({c: rows[c] if c in rows else pd.Series([None] * len(rows), dtype=object) for c in names})


def production_tokenizers() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    return align_documents(documents(spark, sf_dir), *production_tokenizers())
