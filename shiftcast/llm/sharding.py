"""Shards of nearly equal bytes by a k-d tree over document metadata.

A node is split along the metadata dimension in which it is widest, at the weighted
median of its bytes (or the fraction that its number of shards asks for), until every
leaf holds the target bytes. All nodes of a level are split together. A median is
found by narrowing: each round sums bytes into a fixed number of buckets per node, on
the map side first, and goes on inside the bucket that holds the median, so the driver
sees at most ``BUCKETS`` sums per node, whatever the input. Only a slim table of sizes
and keys is read again; texts are read once.

Equal values of a dimension are ordered by the text's checksum and then by a hash of
the id. So a hot value or a large group of copies can be divided anywhere, while
copies otherwise lie side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .common import documents, query, text_of, unsigned_hash

OVERHEAD = 16
BUCKETS = 2048
#: A cut is exact to this part of a shard, or to one row or key.
TOLERANCE = 0.0005
#: Rows numbered together, and the most groups of them per shard.
SLOT_ROWS, SLOT_GROUPS = 500, 4096
_VALUE, _SUM, _ID = 20, 32, 11  # bits of a key: value, checksum, hash of the id


def metadata(text_col: str = "text") -> dict[str, Column]:
    """The default dimensions: language, source, logarithm of the length."""
    return {
        "lang": text_code(F.col("lang")),
        "source": text_code(F.col("source")),
        "length": F.log2(F.octet_length(text_of(text_col)) + 1.0),
    }


def text_code(value: Column) -> Column:
    """A number that orders strings by their first six bytes; null as the empty string."""
    head = F.substring(F.encode(F.coalesce(value, F.lit("")), "UTF-8"), 1, 6)
    return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")


@dataclass
class Node:
    """Shards first .. first + count - 1; low and high bound the cut's key."""

    first: int
    count: int
    dim: int = 0
    low: int = 0
    high: int = 0
    target: float = 0.0
    below: float = 0.0
    cut: int | None = None


def _lookup(values: dict[int, int], key: Column) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.create_map(*[p.cast("long") for p in pairs])[key]


def _descend(rows: DataFrame, nodes: dict[int, Node]) -> DataFrame:
    """Moves rows from the nodes that have a cut to their children."""
    done = {n: node for n, node in nodes.items() if node.cut is not None}
    dim = _lookup({n: node.dim for n, node in done.items()}, F.col("node"))
    cut = _lookup({n: node.cut for n, node in done.items()}, F.col("node"))
    rows = rows.withColumn("__cut", cut).withColumn("__key", F.col("keys")[dim.cast("int")])
    child = 2 * F.col("node") + (F.col("__key") >= F.col("__cut")).cast("long")
    return rows.withColumn("node", F.coalesce(child, F.col("node"))).drop("__cut", "__key")


def _narrow(rows: DataFrame, open_nodes: dict[int, Node], per_shard: float) -> None:
    """One round: sums per bucket, then smaller bounds or the cut of each node."""
    step = {n: max(1, -(-(x.high - x.low) // BUCKETS)) for n, x in open_nodes.items()}
    at = F.col("node")
    inside = (
        rows.where(at.isin(*open_nodes))
        .withColumn("__key", F.col("keys")[_lookup({n: x.dim for n, x in open_nodes.items()}, at).cast("int")])
        .withColumn("__low", _lookup({n: x.low for n, x in open_nodes.items()}, at))
        .where((F.col("__key") >= F.col("__low")) & (F.col("__key") < _lookup({n: x.high for n, x in open_nodes.items()}, at)))
        .withColumn("__step", _lookup(step, at))
        .withColumn("bucket", F.expr("(__key - __low) div __step"))
    )
    sums: dict[int, list] = {n: [] for n in open_nodes}
    for r in inside.groupBy("node", "bucket").agg(F.sum("size").alias("held"), F.count("*").alias("n")).collect():
        sums[r["node"]].append((r["bucket"], r["held"], r["n"]))
    for n, x in open_nodes.items():
        for bucket, held, rows_there in sorted(sums[n]):
            if x.below + held >= x.target:
                break
            x.below += held
        start = x.low + bucket * step[n]
        if step[n] == 1 or rows_there == 1 or held <= TOLERANCE * per_shard:
            nearer_end = x.below + held - x.target < x.target - x.below
            x.cut = start + step[n] if nearer_end else start
        else:
            x.low, x.high = start, min(start + step[n], x.high)


def assign(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: float | None = None,
    dims: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text (null: none) plus 16; slots count from 0 in
    each shard without gaps. Give the number of shards or the bytes of one. ``dims``
    maps names to numeric columns, null counting as 0. Rows that repeat an id are rows
    of their own; which of them gets the lower slot is open. With fewer rows than
    shards some shards stay empty; an empty table gives an empty result.
    """
    values = list((dims or metadata(text_col)).values())
    text = text_of(text_col)
    slim = persist_to_shared(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.array(*[F.coalesce(v.cast("double"), F.lit(0.0)) for v in values]).alias("values"),
        ),
        "shard-sizes",
    )
    axes = range(len(values))
    seen = slim.agg(
        F.sum("size"), F.count("*"), *[f(F.col("values")[d]) for d in axes for f in (F.min, F.max)]
    ).first()
    total, n_rows = seen[0] or 0, seen[1]
    if shards is None:
        shards = max(1, round(total / target_bytes))

    def key(d: int) -> Column:
        low, high = seen[2 + 2 * d], seen[3 + 2 * d]
        cells = F.floor((F.col("values")[d] - (low or 0.0)) / ((high - low) or 1.0 if n_rows else 1.0) * (2**_VALUE - 1))
        value = F.shiftleft(cells.cast("long"), _SUM + _ID)
        return value + F.shiftleft(F.col("text_crc32"), _ID) + unsigned_hash(F.col("doc_id")) % 2**_ID

    keyed = slim.select("doc_id", "size", "text_crc32", F.array(*[key(d) for d in axes]).alias("keys"))
    rows = keyed.withColumn("node", F.lit(1).cast("long"))
    nodes, level = {1: Node(0, shards)}, {1: Node(0, shards)} if shards > 1 and n_rows else {}
    while level:
        extents = rows.where(F.col("node").isin(*level)).groupBy("node").agg(
            F.sum("size").alias("held"),
            *[f(F.col("keys")[d]).alias(f"{name}{d}") for d in axes for name, f in (("low", F.min), ("high", F.max))],
        )
        open_nodes = {}
        for r in extents.collect():
            x = level[r["node"]]
            x.dim = max(axes, key=lambda d: ((r[f"high{d}"] >> (_SUM + _ID)) - (r[f"low{d}"] >> (_SUM + _ID)), -d))
            x.low, x.high = r[f"low{x.dim}"], r[f"high{x.dim}"] + 1
            x.target = r["held"] * (x.count // 2) / x.count
            open_nodes[r["node"]] = x
        for x in level.values():
            x.cut = x.cut if x.low < x.high else 0  # a node without rows
        while waiting := {n: x for n, x in open_nodes.items() if x.cut is None}:
            _narrow(rows, waiting, total / shards)
        nodes |= level
        # Written, or every later round would work out the whole path of each row again.
        rows = persist_to_shared(_descend(rows, level), "shard-nodes")
        below: dict[int, Node] = {}
        for n, x in level.items():
            left = x.count // 2
            below[2 * n] = Node(x.first, left)
            below[2 * n + 1] = Node(x.first + left, x.count - left)
        nodes |= below
        level = {n: x for n, x in below.items() if x.count > 1}
    leaves = {n: x.first for n, x in nodes.items() if x.count == 1}
    shard = _lookup(leaves, F.col("node")) if leaves else F.lit(0)
    placed = rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))
    return _numbered(placed, shards, n_rows)


def _numbered(placed: DataFrame, shards: int, n_rows: int) -> DataFrame:
    """Adds slots: row numbers in groups of a bounded number of rows, moved up by the
    rows of the groups before. There is one offset per group, which bounds the broadcast."""
    groups = min(SLOT_GROUPS, max(1, n_rows // (shards * SLOT_ROWS)))
    placed = placed.withColumn("__group", unsigned_hash(F.col("doc_id"), F.col("text_crc32")) % groups)
    counts = placed.groupBy("shard", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    order = Window.partitionBy("shard", "__group").orderBy("doc_id", "text_crc32")
    numbered = placed.withColumn("__row", F.row_number().over(order))
    return numbered.join(F.broadcast(offsets), ["shard", "__group"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__offset") + F.col("__row") - 1).cast("long").alias("slot")
    )


@query("op4_kd_tree_shards")
def op4(spark, sf_dir):
    """Forty shards under the law of equal bytes."""
    return assign(documents(spark, sf_dir), shards=40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
