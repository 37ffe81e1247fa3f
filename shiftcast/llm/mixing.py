"""Mixes sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold the documents. The token budget
flows down the tree by weight. A node never gets more than its leaves can give; what
is over goes to its siblings by their weights, and only if they are all full does it
reach the siblings of an ancestor. Within a leaf, whole epochs are taken first and
then a prefix of the tokens of one more epoch, in a seeded order of its documents.

The documents meet two aggregations to (leaf, bucket of the seeded order), which
combine on the map side. The bucket in which a leaf's prefix ends is known from the
totals alone, so only the rows of that bucket are ordered, and the cut of each leaf is
one row. The selection itself is a comparison with the cut, after a join whose small
side has one row per leaf; adaptive execution broadcasts it or splits a hot leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import persist_to_shared
from .common import documents, query, text_of, words_of

BUCKETS = 4096
_ORDER_BITS = 60


@dataclass(frozen=True)
class Plan:
    """levels: column expressions from the root down; weights: by level, a value's weight
    among its siblings (others get 1)."""

    levels: dict[str, Column]
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    max_epochs: int = 1
    seed: str = "mix"


def _label(value: Column) -> Column:
    """A null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null"))


def _weight(level: str, plan: Plan) -> Column:
    out = F.lit(1.0)
    for value, weight in plan.weights.get(level, {}).items():
        out = F.when(F.col(level) == f"={value}", F.lit(float(weight))).otherwise(out)
    return out


def seeded_order(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A number below 2^60 from the MD5 of seed, epoch and id."""
    key = F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, _ORDER_BITS // 4), 16, 10).cast("long")


def share_out(nodes: DataFrame, parent: list[str], budget: str, out: str) -> DataFrame:
    """Splits each parent's budget among its children by weight, none above ``cap``.

    The children are filled in the order of cap / weight. Those that come before the
    level where the rest fits are full; the others share what is left by weight.
    """
    order = Window.partitionBy(*parent).orderBy("__full_at", *[c for c in nodes.columns if c.startswith("level_")])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.lit(0.0))
    filled = nodes.withColumn("__full_at", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    filled = filled.withColumn("__left", left).withColumn("__weights", F.sum("weight").over(onward))
    # The level at which water stands is the lowest of left / weights over those not full.
    level = F.when(F.col("__weights") > 0, F.col("__left") / F.col("__weights")).otherwise(F.lit(0.0))
    filled = filled.withColumn("__level", level).withColumn(
        "__water",
        F.max(F.when(F.col("__level") < F.col("__full_at"), F.col("__level"))).over(Window.partitionBy(*parent)),
    )
    given = F.when(F.col("__level") >= F.col("__full_at"), F.col("cap")).otherwise(F.col("weight") * F.col("__water"))
    return filled.withColumn(out, F.least(given, F.col("cap"))).drop(
        "__full_at", "__left", "__weights", "__level", "__water"
    )


def budgets(leaves: DataFrame, plan: Plan, total: float) -> DataFrame:
    """leaf columns, tokens, budget (long): the share of ``total`` tokens of each leaf.

    ``leaves`` has one row per leaf: the levels and its tokens. Levels are windows over
    one row per child, so no group is larger than a node's number of children.
    """
    names = list(plan.levels)
    table = leaves.withColumn("cap", F.col("tokens") * F.lit(float(plan.max_epochs))).withColumn(
        "__total", F.lit(float(total))
    )
    upper = table
    budget = "__total"
    for depth, level in enumerate(names):
        path = names[: depth + 1]
        nodes = upper.groupBy(*path, budget).agg(F.sum("cap").alias("cap"))
        nodes = nodes.withColumn("weight", _weight(level, plan)).withColumn("level_key", F.col(level))
        parent = path[:-1] or [budget]
        shared = share_out(nodes, parent, budget, f"__budget_{depth}").select(*path, f"__budget_{depth}")
        upper = upper.drop(budget).join(shared, path)
        budget = f"__budget_{depth}"
    return upper.select(*names, "tokens", F.floor(F.col(budget) + 1e-6).cast("long").alias("budget"))


def select(
    docs: DataFrame,
    plan: Plan,
    total: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
) -> DataFrame:
    """One row per document and epoch taken: doc_id, the levels, epoch, tokens, taken.

    tokens defaults to the words of the text; ``taken`` is less only for the document at
    which a leaf's prefix ends. The budgets are met to the token. ``total`` defaults to
    all tokens there are. Documents without tokens (null or empty texts) are taken in
    every whole epoch. Nulls of a level are a value of their own. Ties of the seeded
    order (rows that repeat a doc_id) fall by their tokens; rows equal in both share what
    is left for them, short of their number of tokens at most. An empty table gives an
    empty result.
    """
    values = [F.when(F.col(k) != "null", F.substring(k, 2, 2**31 - 1)).alias(k) for k in plan.levels]
    return _chosen(docs, plan, total, id_col, text_col, tokens, []).select(
        "doc_id", *values, "epoch", "tokens", "taken"
    )


def _chosen(docs, plan, total, id_col, text_col, tokens, carry):
    """The rows taken, levels as labels."""
    names = list(plan.levels)
    counted = F.size(words_of(text_col)).cast("long") if tokens is None else tokens
    slim_columns = [
        F.col(id_col).alias("doc_id"),
        *[_label(c).alias(k) for k, c in plan.levels.items()],
        counted.alias("tokens"),
    ]
    slim = persist_to_shared(docs.select(*slim_columns), "mix-tokens")
    leaves = slim.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    if total is None:
        total = slim.agg(F.sum("tokens")).first()[0] or 0
    shares = budgets(leaves, plan, total)
    # A leaf without tokens has nothing to repeat.
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    shares = persist_to_shared(
        shares.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")),
        "mix-budgets",
    )
    cut = persist_to_shared(_cuts(slim, shares, plan), "mix-cuts")

    rows = docs.select(*slim_columns, *carry).join(cut.withColumnRenamed("tokens", "__leaf_tokens"), names)
    place = seeded_order(plan.seed, F.col("whole"), F.col("doc_id"))
    position = F.struct(place.alias("o"), F.col("doc_id").alias("i"), F.col("tokens").alias("t"))
    prefix = F.when(position < F.col("cut"), F.col("tokens")).when(position == F.col("cut"), F.col("cut_taken"))
    epochs = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<long>"))
    epochs = F.concat(epochs, F.when(prefix > 0, F.array("whole")).otherwise(F.array().cast("array<long>")))
    picked = rows.withColumn("__prefix", prefix).withColumn("epoch", F.explode(epochs))
    taken = F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("__prefix"))
    return picked.withColumn("taken", taken)


def _cuts(slim: DataFrame, shares: DataFrame, plan: Plan) -> DataFrame:
    """shares with, per leaf, the document at which its last epoch ends and what is taken of it."""
    names = list(plan.levels)
    partial = shares.where("rest > 0").select(*names, "whole", "rest")
    placed = slim.join(partial, names).withColumn("o", seeded_order(plan.seed, F.col("whole"), F.col("doc_id")))
    width = 2**_ORDER_BITS // BUCKETS
    placed = placed.withColumn("bucket", F.expr(f"o div {width}L"))
    sums = placed.groupBy(*names, "bucket", "rest").agg(F.sum("tokens").alias("held"))
    upto = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("held").over(upto))
    last = sums.where("upto >= rest and upto - held < rest").select(
        *names, "bucket", (F.col("rest") - F.col("upto") + F.col("held")).alias("wanted")
    )
    inside = placed.join(last, [*names, "bucket"])
    # Rows equal in all of this share what is left for them.
    order = Window.partitionBy(*names).orderBy("o", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        inside.groupBy(*names, "o", "doc_id", "tokens", "wanted")
        .agg(F.count("*").alias("alike"))
        .withColumn("upto", F.sum(F.col("tokens") * F.col("alike")).over(order))
        .withColumn("left", F.col("wanted") - F.col("upto") + F.col("tokens") * F.col("alike"))
    )
    ends = inside.where("upto >= wanted and left > 0").select(
        *names,
        F.struct(F.col("o"), F.col("doc_id").alias("i"), F.col("tokens").alias("t")).alias("cut"),
        F.expr("left div alike").alias("cut_taken"),
    )
    return shares.join(ends, names, "left")


def mix(docs: DataFrame, plan: Plan, total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``select`` with all columns of the input, one row per epoch.

    The text of the document at which a leaf's prefix ends is cut after its last word
    taken. Input columns keep their names and types, whatever they are called.
    """
    carry = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")]
    picked = _chosen(docs, plan, total, id_col, text_col, None, carry)
    text = F.col(f"__row.`{text_col}`")
    # Possessive, so that the match runs in a loop however many words there are.
    start = F.concat(F.lit(r"\A(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("taken"), F.lit("}+"))
    head = F.call_function("regexp_extract", text, start, F.lit(0))
    cut = F.when(F.col("taken") < F.col("tokens"), head).otherwise(text)
    return picked.select(*[cut.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def production_plan() -> Plan:
    """The domain of the sources is web for the one crawl and curated for the rest."""
    domain = F.when(F.col("source") == "src0", F.lit("web")).otherwise(F.lit("curated"))
    return Plan(
        levels={"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        weights={"domain": {"web": 1.0, "curated": 3.0}, "lang": {"en": 2.0}},
        max_epochs=2,
        seed="mix-1",
    )


def _split(table: str, parent: str, child: str, budget: str, weight: str) -> str:
    """SQL that shares a parent's budget out among its children."""
    return f"""
        SELECT *, CASE WHEN level >= full_at THEN cap
                       ELSE least(cap, weight * max(CASE WHEN level < full_at THEN level END) OVER (PARTITION BY {parent})) END AS given
        FROM (
            SELECT *, cap / weight AS full_at,
                   greatest({budget} - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)
                   / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM (SELECT *, {weight} AS weight FROM {table})
            WINDOW o AS (PARTITION BY {parent} ORDER BY cap / weight, {child})
        )"""


@query(
    "op8_source_mixing",
    rf"""
    WITH docs AS (
        SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' ELSE 'curated' END AS domain, lang, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens
        FROM documents
    ), leaves AS (
        SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE * 2 AS cap
        FROM docs GROUP BY ALL
    ), d AS (
        SELECT domain, sum(cap) AS cap, (SELECT sum(tokens)::DOUBLE FROM docs) AS total FROM leaves GROUP BY domain
    ), db AS ({_split("d", "total", "domain", "total", "CASE domain WHEN 'web' THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END")}
    ), l AS (
        SELECT domain, lang, sum(leaves.cap) AS cap, any_value(given) AS up
        FROM leaves JOIN db USING (domain) GROUP BY domain, lang
    ), lb AS ({_split("l", "domain", "lang", "up", "CASE lang WHEN 'en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END")}
    ), s AS (
        SELECT leaves.*, given AS up FROM leaves JOIN lb USING (domain, lang)
    ), sb AS ({_split("s", "domain, lang", "source", "up", "1.0::DOUBLE")}
    ), shares AS (
        SELECT domain, lang, source, floor(given + 1e-6)::BIGINT AS budget,
               CASE WHEN tokens > 0 THEN floor(given + 1e-6)::BIGINT // tokens ELSE 0 END AS whole,
               tokens AS leaf_tokens FROM sb
    ), placed AS (
        SELECT docs.*, whole, budget - whole * leaf_tokens AS rest,
               sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY
                   ('0x' || substr(md5(concat_ws(':', 'mix-1', whole, doc_id)), 1, 15))::BIGINT, doc_id
                   ROWS UNBOUNDED PRECEDING) AS upto
        FROM docs JOIN shares USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, unnest(range(whole)) AS epoch, tokens, tokens AS taken FROM placed
    UNION ALL
    SELECT doc_id, domain, lang, source, whole, tokens, least(tokens, rest - upto + tokens)
    FROM placed WHERE rest - upto + tokens > 0 AND tokens > 0
    """,
)
def op8(spark, sf_dir):
    return select(documents(spark, sf_dir), production_plan())
