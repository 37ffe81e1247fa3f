"""Erlang-C queueing formulas as column expressions.

The waiting probability is built from the inverse of the Erlang-B blocking
probability, ``I(0) = 1, I(k) = 1 + I(k-1) k / a``, which needs no powers or
factorials: ``C(n) = n / ((n - a) I(n) + a)``. The textbook sum overflows near
140 Erlang.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def traffic_intensity(volume: Column, aht_minutes: Column, interval_minutes: float = 60.0) -> Column:
    """Offered load in Erlang; 0 where volume or handling time is not positive."""
    return F.when(
        (volume > 0) & (aht_minutes > 0), volume * aht_minutes / F.lit(interval_minutes)
    ).otherwise(F.lit(0.0))


def _inverse_blocking(a: Column, upto: Column) -> Column:
    """I(upto); the sequence starts at 0, whose step leaves the 1 as it is."""
    return F.aggregate(F.sequence(F.lit(0), upto.cast("int")), F.lit(1.0), lambda inv, k: 1 + inv * k / a)


def _waiting(inverse: Column, n: Column, a: Column) -> Column:
    """Waiting probability for n > a."""
    return n / ((n - a) * inverse + a)


def wait_probability(agents: Column, a: Column) -> Column:
    return (
        F.when((agents <= 0) | (a <= 0), F.lit(0.0))
        .when(a >= agents, F.lit(1.0))
        .otherwise(_waiting(_inverse_blocking(a, agents), agents, a))
    )


def wait_seconds(c: Column, agents: Column, a: Column, aht_seconds: Column) -> Column:
    """Mean wait given the waiting probability ``c``; NULL if the queue never drains."""
    return F.when(agents > a, c * aht_seconds / (agents - a))


def service_level(c: Column, agents: Column, a: Column, aht_seconds: Column, target: Column) -> Column:
    reached = 1 - c * F.exp(-(agents - a) * target / aht_seconds)
    return F.when(agents <= a, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), reached))
    )


def solve_agents(
    a: Column, aht_seconds: Column, goal: Column, target: Column, max_agents: int = 500
) -> Column:
    """``struct(n, c)``: fewest agents reaching the goal, and their waiting probability.

    Up to the load itself one cheap fold builds I. From there on a second fold
    tests one agent count per step and stands still once it has found one. The
    answer usually lies within two square roots of the load; only where it does
    not, the fold goes on to ``max_agents``, which is the answer if none suffices.
    """
    before = F.ceil(a) - 1
    near = F.least(F.lit(max_agents), before + 6 + F.ceil(2 * F.sqrt(a)))

    def step(state: Column, k: Column) -> Column:
        inverse = 1 + state["i"] * k / a
        # At k = a the waiting probability is 1 and the level 0, as for an overloaded queue.
        meets = 1 - _waiting(inverse, k, a) * F.exp((a - k) * target / aht_seconds) >= goal
        return F.when(state["n"].isNotNull(), state).otherwise(
            F.struct(inverse.alias("i"), F.when(meets, k).alias("n"))
        )

    def search(start: Column, first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first.cast("int"), last.cast("int")), start, step)

    def settle(short: Column) -> Column:
        done = short["n"].isNotNull() | (near >= max_agents)
        found = F.when(done, short).otherwise(search(short, near + 1, F.lit(max_agents)))
        return _let(found, result)

    def result(found: Column) -> Column:
        n = F.coalesce(found["n"], F.lit(max_agents))
        return F.struct(n.alias("n"), _waiting(found["i"], n, a).alias("c"))

    start = F.struct(_inverse_blocking(a, before).alias("i"), F.lit(None).cast("int").alias("n"))
    solved = _let(search(start, before + 1, near), settle)
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c"))
    full = F.struct(F.lit(max_agents).alias("n"), F.lit(1.0).alias("c"))
    return F.when(a <= 0, nothing).when(a >= max_agents, full).otherwise(solved)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def required_agents(
    a: Column, aht_seconds: Column, goal: float = 0.8, target: float = 20.0, max_agents: int = 500
) -> Column:
    return solve_agents(a, aht_seconds, F.lit(goal), F.lit(target), max_agents)["n"]
