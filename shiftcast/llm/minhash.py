"""Near-duplicates by min-max hashing, banding and exact confirmation.

Each permutation of the shingle hashes gives two entries of a signature, its minimum
and its maximum, so a signature of 140 entries takes 70 permutations. Documents that
agree on a whole band are candidates.

* Documents with equal shingle sets become one class first, so copies meet no join.
* Candidates of a bucket are compared with one leader of the bucket, not with each
  other: pairs grow with the rows, not with the square of a group. What a leader
  links is in its component.
* Only buckets that still hold several components after that go on. Their members
  outside the main component are compared with the rest of the bucket inside tasks, in
  blocks of a bounded number of members, which emit confirmed links only. So in the
  end every pair of a bucket has been compared or is connected.
* A link is confirmed on the full shingle sets, whatever the signature says. Sets are
  made a second time, for one document of each node that shares a bucket, so that only
  slim signatures are written for all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .batches import map_frames, slim_documents
from .common import documents, query, text_of
from .components import components

BANDS, ROWS = 28, 5
LEADER_ROUNDS = 2
#: Members outside and inside the main component that one task compares at once.
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024

#: Up to so many candidates, buckets or dropped documents are looked up by a broadcast, 16 bytes each.
BROADCAST_KEYS = 1_000_000


class Signer:
    """Shingle sets and band keys of texts."""

    def __init__(self, words: int, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        half = -(-bands * rows // 2)
        self.words, self.bands, self.rows = words, bands, rows
        self.multiply = rng.integers(1, 2**63, half, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**63, half, np.uint64)
        self.fold = rng.integers(1, 2**63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        # A band takes entries that lie apart, so that a permutation's minimum and maximum seldom share one.
        self.order = np.arange(2 * half).reshape(2, half).ravel()[: bands * rows]
        self.word_hashes: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles; of all words if there are fewer."""
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
        if not words:
            return np.empty(0, np.uint64)
        known = self.word_hashes
        if len(known) > 500_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(one) - self.words + 1
        size = self.words if n > 0 else len(one)
        mixed = np.full(max(n, 1), np.uint64(size), np.uint64)
        for k in range(size):
            mixed = mix((mixed * np.uint64(0x9E3779B97F4A7C15)) ^ one[k : k + len(mixed)])
        return np.unique(mixed)

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One key per band, from the minima and maxima under all permutations."""
        low = np.full(len(self.multiply), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(self.multiply), np.uint64)
        for at in range(0, len(shingles), 4096):
            turned = self.multiply[:, None] * shingles[None, at : at + 4096] + self.add[:, None]
            np.minimum(low, turned.min(axis=1), out=low)
            np.maximum(high, turned.max(axis=1), out=high)
        entries = np.concatenate([low, high])[self.order].reshape(self.bands, self.rows)
        keys = mix((mix(entries) * self.fold).sum(axis=1, dtype=np.uint64))
        return mix(keys + np.arange(self.bands, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and what finds a document again."""
    rows = slim_documents(docs, id_col, text_col)
    return rows.withColumns({"text_key": F.xxhash64("text"), "id_key": F.coalesce("doc_id", F.lit(0))})


def node_name(shingles: np.ndarray) -> bytes:
    """Names a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def sign(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """Of keyed rows: doc_id, text_key, id_key, n_shingles, node (names the set), bands."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(words, bands, per_band)
        for frame in frames:
            sets = [signer.shingles(t) for t in frame["text"]]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame.drop(columns="text").assign(
                n_shingles=[len(s) for s in sets],
                node=[node_name(s) for s in sets],
                bands=[signer.band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets],
            )

    schema = "doc_id long, text_key long, id_key long, n_shingles long, node binary, bands array<long>"
    return map_frames(rows, work, schema)


def full_sets(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """Of keyed rows: node, shingles, bands."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(words, bands, per_band)
        for frame in frames:
            sets = [signer.shingles(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "node": [node_name(s) for s in sets],
                    "shingles": [s.view(np.int64) for s in sets],
                    "bands": [signer.band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets],
                }
            )

    return map_frames(rows.select("text"), work, "node binary, shingles array<long>, bands array<long>")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. A document's set holds
    its distinct shingles of ``words`` words, with fewer words all of them as one.
    Documents are linked if the sets' intersection is at least ``percent`` of the
    union; component_id is the least doc_id of the connected documents, and that
    document is kept. A pair at the very threshold of 80 percent shares no band with
    probability (1 - 0.8^rows)^bands, 1.5 in 100 000 by default; shingles are known by
    64-bit hashes.

    A document without words (null or empty text) has an empty set and is linked with
    nothing. Null ids take part; a component of null ids only has a null component_id
    and keeps its rows. Rows that repeat a doc_id share its verdict. An empty table
    gives an empty result.
    """
    marks = marked(docs, words, percent, bands, rows, id_col, text_col)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return marks.select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def marked(docs: DataFrame, words: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, root (names the component, null
    for an empty set), component_id."""
    source = keyed(docs, id_col, text_col)
    signed = persist_to_shared(sign(source, words, bands, rows), "signatures")
    buckets = _buckets(signed)
    # One document of each node that shares a bucket.
    place = F.min(F.struct("text_key", "id_key")).alias("place")
    nodes = buckets.select("node").distinct()
    places = signed.select("node", "text_key", "id_key").join(nodes, "node").groupBy("node").agg(place)
    places = persist_to_shared(places.select("place.*"), "candidates")
    small = places.count() <= BROADCAST_KEYS
    picked = source.join(F.broadcast(places) if small else places, ["text_key", "id_key"], "left_semi")
    full = persist_to_shared(full_sets(picked, words, bands, rows).dropDuplicates(["node"]), "full-sets")
    roots = _connected(buckets, full, percent)
    least = (
        signed.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"))
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    component = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(component, "root").select("node", "root", "component_id")
    # Only sets that stand for several rows or nodes need the join.
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "text_key", "n_shingles", "root", "component_id")


def _buckets(signed: DataFrame) -> DataFrame:
    """(bucket, node, n, fame) of the buckets with several nodes.

    fame is the number of members of all buckets of the node. It is highest for the text
    that most others are variants of, which so becomes the leader of its buckets.
    """
    members = signed.select(
        F.explode("bands").alias("bucket"), "node", F.col("n_shingles").cast("int").alias("n")
    )
    # A bucket has several nodes if their hashes differ.
    other = F.xxhash64("node")
    several = members.groupBy("bucket").agg(F.min(other).alias("x"), F.max(other).alias("y")).where("x <> y")
    several = persist_to_shared(several.select("bucket"), "shared-buckets")
    few = several.count() <= BROADCAST_KEYS
    held = members.join(F.broadcast(several) if few else several, "bucket").distinct()
    held = persist_to_shared(held, "members")
    sizes = held.groupBy("bucket").agg(F.count("*").alias("size"))
    fame = held.join(sizes, "bucket").groupBy("node").agg(F.sum("size").alias("fame"))
    return persist_to_shared(held.join(fame, "node").select("bucket", "node", "n", "fame"), "buckets")


def _connected(buckets: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another."""
    spark = buckets.sparkSession
    links = spark.createDataFrame([], "a binary, b binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    for _ in range(LEADER_ROUNDS):
        here, open_ = _unsettled(buckets, roots)
        pairs = (
            here.join(open_, "bucket")
            .where("root <> led_by.root")
            .where(percent * F.greatest("n", "led_by.n") <= 100 * F.least("n", "led_by.n"))
            .select(F.least("node", "led_by.node").alias("a"), F.greatest("node", "led_by.node").alias("b"))
            .distinct()
        )
        found = persist_to_shared(_confirmed(persist_to_shared(pairs, "pairs"), full, percent), "confirmed")
        if not found.isEmpty():
            links = persist_to_shared(links.unionByName(found), "links")
            roots = persist_to_shared(components(links), "roots")
        # A leader is now known against its whole bucket.
        here, open_ = _unsettled(buckets, roots)
        buckets = here.join(open_, "bucket").where("node <> led_by.node").select("bucket", "node", "n", "fame")
        buckets = persist_to_shared(buckets, "buckets")
        if buckets.isEmpty():
            return roots
    found = persist_to_shared(_in_blocks(buckets, roots, full, percent), "confirmed")
    return roots if found.isEmpty() else components(links.unionByName(found))


def _in_blocks(buckets: DataFrame, roots: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links between the components that meet in a bucket, by comparison in blocks."""
    here, open_ = _unsettled(buckets, roots)
    here = here.join(open_, "bucket").withColumn("asks", F.col("root") != F.col("led_by.root"))
    sizes = here.groupBy("bucket").agg(
        F.ceil(F.sum(F.col("asks").cast("int")) / QUERY_BLOCK).alias("query_blocks"),
        F.ceil(F.count("*") / MEMBER_BLOCK).alias("member_blocks"),
    ).where("query_blocks > 0")
    here = persist_to_shared(here.join(sizes, "bucket").drop("led_by", "fame"), "open-members")
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ["bucket", "node", "root"]
    members = here.select(*columns, F.lit(False).alias("asks"), spot("member_blocks").alias("m"), every("query_blocks").alias("q"))
    queries = here.where("asks").select(*columns, "asks", every("member_blocks").alias("m"), spot("query_blocks").alias("q"))
    blocks = members.unionByName(queries).join(full, "node")
    compare = lambda frame: compare_block(frame, percent)
    return blocks.groupBy("bucket", "q", "m").applyInPandas(compare, "a binary, b binary").distinct()


def compare_block(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between the asking rows and the others, one per other component.

    A pair that meets in several buckets is compared in that of its first common band.
    """
    asks = frame["asks"].to_numpy(bool)
    there = frame[~asks].reset_index(drop=True)
    roots = there["root"].to_numpy()
    sets = [np.asarray(x) for x in there["shingles"]]
    sizes = np.array([len(x) for x in sets])
    bands = np.array(there["bands"].tolist())
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(sets)), sizes)[order]
    links = []
    for row in frame[asks].itertuples():
        mine, own = np.asarray(row.shingles), np.asarray(row.bands)
        band = int(np.flatnonzero(own == row.bucket)[0])
        wanted = (roots != row.root) & ~(bands[:, :band] == own[:band]).any(axis=1)
        wanted &= percent * np.maximum(sizes, len(mine)) <= 100 * np.minimum(sizes, len(mine))
        if not wanted.any():
            continue
        low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        count = high - low
        at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        shared = np.bincount(owners[at], minlength=len(sets))
        linked = wanted & (100 * shared >= percent * (sizes + len(mine) - shared))
        for _, k in {roots[k]: k for k in np.flatnonzero(linked)}.items():
            links.append((min(row.node, there["node"][k]), max(row.node, there["node"][k])))
    return pd.DataFrame(links, columns=["a", "b"])


def _unsettled(buckets: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their roots, and the buckets of several components with their leaders.

    The leader is the member of most fame.
    """
    here = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rank = F.struct("fame", "node", "root", "n")
    found = here.groupBy("bucket").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.max(rank).alias("led_by")
    )
    return here, found.where("least <> most").select("bucket", "led_by")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = full.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = full.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("n", F.size(F.array_intersect("x", "y"))).where(
        100 * F.col("n") >= percent * (F.size("x") + F.size("y") - F.col("n"))
    ).select("a", "b")


def drop_near_copies(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One document of each group of near copies, and the documents without any, with all columns.

    The least doc_id stays, null after all others; of several texts with this doc_id the one
    of the least hash. Verdicts are on (doc_id, text), so another row of a dropped doc_id is
    not touched, and rows equal in both are one document. Documents without words stay.
    Columns of any name pass through; an empty table gives an empty result.

    The texts meet no shuffle up to BROADCAST_KEYS dropped documents and one beyond.
    """
    marks = marked(docs, words, percent, bands, rows, id_col, text_col).where("root IS NOT NULL")
    marks = persist_to_shared(marks.select("root", "doc_id", "text_key"), "verdicts")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    groups = marks.groupBy("root").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    groups = persist_to_shared(groups.where("first <> last").select("root", "first"), "near-groups")
    few = groups.count() <= BROADCAST_KEYS
    left_out = marks.join(F.broadcast(groups) if few else groups, "root").where(rank != F.col("first"))
    dropped = left_out.select(F.col("doc_id").alias("id"), "text_key").distinct()
    dropped = persist_to_shared(dropped, "near-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"))
    small = dropped.count() <= BROADCAST_KEYS
    same = [tagged["text_key"] == dropped["text_key"], tagged["doc_id"].eqNullSafe(dropped["id"])]
    return tagged.join(F.broadcast(dropped) if small else dropped, same, "left_anti").select("row.*")


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir), words=2)
