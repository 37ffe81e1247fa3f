"""Special functions of statistics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Coefficients of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0, by Stirling's series eight steps further up."""

    def series(z: Column) -> Column:
        tail = sum((F.lit(c) / F.pow(z, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))
        return (z - 0.5) * F.log(z) - z + F.log(F.lit(2.0) * F.pi()) / 2 + tail

    steps = sum((F.log(x + k) for k in range(8)), F.lit(0.0))
    return bind(x + 8, series) - steps


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), as a fold.

    It converges within a multiple of the root of the larger parameter.
    """
    tiny = F.lit(1e-300)
    away = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)
    begin = bind(
        1 / away(1 - (a + b) * x / (a + 1)), lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    )

    def taken(state: Column, term: Column) -> Column:
        def next_state(pair: Column) -> Column:
            c, d = pair["c"], 1 / pair["d"]
            return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

        return bind(F.struct(away(1 + term / state["c"]).alias("c"), away(1 + term * state["d"]).alias("d")), next_state)

    def step(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return bind(taken(state, even), lambda s: taken(s, odd))

    rounds = F.sequence(F.lit(1), F.lit(60) + F.ceil(4 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(rounds, begin, step, lambda state: state["h"])


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1; NULL where an argument is."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    straight = front * _beta_fraction(a, b, x) / a
    mirrored = 1 - front * _beta_fraction(b, a, 1 - x) / b
    inside = F.when(x < (a + 1) / (a + b + 2), straight).otherwise(mirrored)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x.isNotNull(), inside)


def f_survival(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) of an F distribution with d1 and d2 degrees of freedom."""
    return F.when(f <= 0, F.lit(1.0)).when(f.isNotNull(), beta_share(d2 / (d2 + d1 * f), d2 / 2, d1 / 2))
