"""Exact quantiles that stay distributed however large a group is.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is right
for hourly series, whose length the calendar bounds. For raw values of a group of any size
the wanted ranks are narrowed down: a round cuts the range that holds a rank into equal
parts, sums the rows of each part, and goes on with the part that holds it. A round moves a
bounded number of sums per group and rank, whatever the rows. What is left when a range
holds few rows is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_to_shared

#: Parts of a range, and rows below which a range is ordered.
PARTS, FEW_ROWS = 1024, 20_000
#: Up to so many ranges go to the rows as a broadcast, some 60 bytes each; more are joined.
BROADCAST_RANGES = 200_000
#: Tasks over which a key's rows spread when they are joined with its ranges.
SALTS = 32


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one column per entry of ``shares``.

    NULL and NaN are no values; a group without any has no row. Each round reads the rows again: what is dear to compute should be stored first.
    """
    return _quantiles(df, keys, value, F.lit(1).cast("bigint"), shares)


def quantiles_of_counts(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The same from ``(keys, value, n)``, where a row stands for n values."""
    return _quantiles(counts, keys, value, F.col("n"), shares)


def _quantiles(rows: DataFrame, keys: list[str], value: str, weight: Column, shares: dict[str, float]) -> DataFrame:
    v = F.col("_v")
    slim = rows.select(*keys, F.col(value).alias("_v"), weight.alias("_w"))
    slim = slim.filter(v.isNotNull() & ~F.isnan(v.cast("double")))
    whole = slim.groupBy(*keys).agg(F.sum("_w").alias("total"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    whole = whole.filter("total > 0")

    def ranks(q: float) -> tuple[Column, Column]:
        position = (F.col("total") - 1) * F.lit(q)
        return F.floor(position).cast("bigint"), F.ceil(position).cast("bigint")

    wanted = F.explode(F.array_distinct(F.array(*[r for q in shares.values() for r in ranks(q)])))
    ranges = whole.select(*keys, "total", wanted.alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.col("total").alias("held"))
    ranges = persist_to_shared(ranges, "ranges")
    while not (open_ := ranges.filter("lo < hi AND held > %d" % FEW_ROWS)).isEmpty():
        narrowed = _narrowed(slim, keys, open_)
        ranges = persist_to_shared(ranges.filter("NOT (lo < hi AND held > %d)" % FEW_ROWS).unionByName(narrowed), "ranges")
    found = ranges.filter("lo = hi").select(*keys, "total", "rank", F.col("lo").alias("_v"))
    found = found.unionByName(_ordered(slim, keys, ranges.filter("lo < hi")))
    return _interpolated(persist_to_shared(found, "ranks"), keys, shares, ranks)


def _in_ranges(slim: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """The rows of each range, beside it; a row may lie in the ranges of several ranks."""
    if not keys or ranges.count() <= BROADCAST_RANGES:
        small = F.broadcast(ranges)
        met = slim.join(small, keys) if keys else slim.crossJoin(small)  # a row per wanted rank
    else:
        salted = slim.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)))
        copies = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = salted.join(copies, [*keys, "_salt"]).drop("_salt")
    return met.filter((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))


def _narrowed(slim: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """Each range cut down to the part that holds its rank, and there to the values that occur."""
    by = [*keys, "total", "rank", "lo", "hi", "below"]
    place = (F.col("_v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
    inner = F.least(F.floor(F.nanvl(place, F.lit(0.5)) * PARTS), F.lit(PARTS - 1))
    # The ends are parts of their own: so a range always shrinks, also one that reaches to infinity.
    part = F.when(F.col("_v") == F.col("lo"), -1).when(F.col("_v") == F.col("hi"), PARTS).otherwise(inner).cast("int")
    sums = _in_ranges(slim, keys, ranges).groupBy(*by, part.alias("part")).agg(
        F.sum("_w").alias("w"), F.min("_v").alias("least"), F.max("_v").alias("most")
    )
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    placed = sums.withColumn("start", F.col("below") + F.coalesce(F.sum("w").over(before), F.lit(0)))
    holding = placed.filter((F.col("start") <= F.col("rank")) & (F.col("rank") < F.col("start") + F.col("w")))
    return holding.select(
        *keys, "total", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), F.col("w").alias("held")
    )


def _ordered(slim: DataFrame, keys: list[str], ranges: DataFrame) -> DataFrame:
    """The value at the rank of each range that holds few rows."""
    by = [*keys, "total", "rank", "below"]
    counts = _in_ranges(slim, keys, ranges).groupBy(*by, "_v").agg(F.sum("_w").alias("w"))
    until = F.sum("w").over(Window.partitionBy(*by).orderBy("_v"))
    placed = counts.withColumn("until", F.col("below") + until)
    hit = (F.col("until") > F.col("rank")) & (F.col("until") - F.col("w") <= F.col("rank"))
    return placed.filter(hit).select(*keys, "total", "rank", "_v")


def _interpolated(found: DataFrame, keys: list[str], shares: dict[str, float], ranks) -> DataFrame:
    aggs: list[Column] = [F.max("total").alias("n")]
    for name, q in shares.items():
        for side, rank in zip(("lo", "hi"), ranks(q)):
            aggs.append(F.max(F.when(F.col("rank") == rank, F.col("_v"))).alias(f"_{name}_{side}"))
        position = (F.col("total") - 1) * F.lit(q)
        aggs.append(F.max(position - F.floor(position)).alias(f"_{name}_f"))
    lerp = {
        name: F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_f")
        for name in shares
    }
    return found.groupBy(*keys).agg(*aggs).withColumns(lerp).select(*keys, "n", *shares)
