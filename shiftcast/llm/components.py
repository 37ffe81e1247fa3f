"""Connected components of a graph given as pairs, by label propagation on stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import persist_to_shared


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b); root is the component's least node.

    Alternates the large-star and small-star steps until nothing changes, about the
    logarithm of the number of nodes in steps. Both are aggregations to the least
    neighbour and a join back, so no node's neighbours are gathered in one task.
    """
    pairs = persist_to_shared(links.select("a", "b").where("a <> b").distinct(), "links")
    before = None
    while (now := _digest(pairs)) != before:
        # Stars in the end: every node points to a root that points nowhere.
        before = now
        pairs = persist_to_shared(_star(_star(pairs, large=True), large=False).distinct(), "stars")
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(pairs: DataFrame) -> tuple:
    """Number of the pairs, all of them different, and two hashes of the set of them."""
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", F.lit(1), "a")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two)).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b. large: of each node, the neighbours above it are linked to
    the least of its neighbourhood; small: those below it and the node itself."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("a > b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    moved = (both.where("b > a") if large else both).join(least, "a")
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b")
