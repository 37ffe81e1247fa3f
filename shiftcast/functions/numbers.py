"""Numeric helpers: safe ratios, rounding, normal quantiles, display forms."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import _c

# Coefficients of Acklam's rational approximation of the inverse
# normal distribution (public algorithm).
_ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
             1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
             6.680131188771972e01, -1.328068155288572e01)
_ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00)


def z_score(confidence: float) -> float:
    """Two-sided normal quantile of a confidence level."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator instead of raising."""
    return F.try_divide(num, den)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def non_negative(x: Column | str) -> Column:
    """``max(0, x)``; a NULL stays NULL, which ``greatest`` alone would drop."""
    return F.when(_c(x) < 0, F.lit(0.0)).otherwise(_c(x))


def finite(x: Column | str) -> Column:
    """NULL for NaN and both infinities."""
    c = _c(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def pct_error(pred: Column, actual: Column, zero_policy: str = "nonzero") -> Column:
    """Absolute error in percent of the actual, as a fraction of 1.

    ``positive``: only actuals above zero count; ``nonzero``: every actual but
    zero; ``zero_is_0``: an actual at or below zero counts as no error.
    """
    err = F.abs(ratio(pred - actual, F.nullif(actual, F.lit(0.0))))
    if zero_policy == "nonzero":
        return err
    if zero_policy == "positive":
        return F.when(actual > 0, err)
    if zero_policy == "zero_is_0":
        return F.when(actual > 0, err).otherwise(F.lit(0.0))
    raise ValueError(f"unknown zero policy {zero_policy!r}")


def _poly(x: Column, coefs: tuple[float, ...]) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution for 0 < p < 1 (relative error below 1.2e-9)."""
    low = 0.02425
    q = p - 0.5
    r = q * q
    centre = _poly(r, _ACKLAM_A) * q / (_poly(r, _ACKLAM_B) * r + 1)
    tail_p = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail_p))
    tail = _poly(t, _ACKLAM_C) / (_poly(t, _ACKLAM_D) * t + 1)
    return F.when(tail_p >= low, centre).when(p < 0.5, tail).otherwise(-tail)


def normal_density(x: Column, mean: Column, std: Column) -> Column:
    z = ratio(x - mean, std)
    return ratio(F.exp(-z * z / 2), std * F.sqrt(F.lit(2.0) * F.pi()))


def compact_number(x: Column) -> Column:
    """``1.2M``, ``3.4K`` or the plain number without decimals."""
    size = F.abs(x)
    return (
        F.when(size >= 1_000_000, F.format_string("%.1fM", x / 1e6))
        .when(size >= 1_000, F.format_string("%.1fK", x / 1e3))
        .otherwise(F.format_string("%.0f", x))
    )


def humanize_seconds(seconds: Column) -> Column:
    def unit(size: int, name: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {name}(s)"))

    return (
        F.when(seconds < 60, unit(1, "second"))
        .when(seconds < 3600, unit(60, "minute"))
        .when(seconds < 86400, unit(3600, "hour"))
        .otherwise(unit(86400, "day"))
    )


# Display names of the workload columns.
DISPLAY_NAMES = {
    "call_volume": "Anrufvolumen",
    "email_count": "E-Mail-Volumen",
    "outbound_ook": "Outbound OOK",
    "outbound_omk": "Outbound OMK",
    "outbound_nb": "Outbound NB",
    "calls": "Anrufe",
    "emails": "E-Mails",
    "outbound": "Outbound",
}


def display_name(task: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in DISPLAY_NAMES.items() for v in kv])
    fallback = F.initcap(F.replace(task, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(known, task), fallback)
