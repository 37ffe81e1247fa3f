"""Trend, seasonality and residual of dense series, autocorrelation, stationarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.special import bind
from .features import interpolate
from .moments import cross_products, matrix, sweep, types_of


def decompose(
    df: DataFrame, keys: list[str], column: str = "volume", period: int = 24, model: str = "additive"
) -> DataFrame:
    """Classical decomposition: observed, trend, seasonal, residual per row.

    The trend is the centred moving average (half weights at both ends of an
    even period); its ends follow the line through the first and last ``period``
    trend points. All steps window over one series, on one partitioning.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model {model!r}")
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("ts")
    half = period // 2
    x = F.col("observed")
    base = interpolate(df, keys, column).withColumnRenamed(column, "observed")
    base = base.withColumns(
        {"_i": F.row_number().over(ordered) - 1, "_n": F.count(F.lit(1)).over(whole)}
    )
    frame = ordered.rowsBetween(-half, half)
    ends = F.lit(0.0)
    if period % 2 == 0:
        ends = (F.lag("observed", half).over(ordered) + F.lead("observed", half).over(ordered)) / 2
    inside = F.count("observed").over(frame) == 2 * half + 1
    base = base.withColumn("_t", F.when(inside, (F.sum("observed").over(frame) - ends) / period))
    # Lines through the first and the last full stretch of trend points.
    first, last = F.lit(half), F.col("_n") - 1 - half
    head = (F.col("_i") >= first) & (F.col("_i") < F.least(first + period, last))
    tail = (F.col("_i") >= F.greatest(first, last - period)) & (F.col("_i") < last)
    fits = {}
    for name, part in (("h", head), ("e", tail)):
        y, at = F.when(part, F.col("_t")), F.when(part, F.col("_i").cast("double"))
        fits[f"_{name}s"] = F.regr_slope(y, at).over(whole)
        fits[f"_{name}c"] = F.regr_intercept(y, at).over(whole)
    base = base.withColumns(fits)
    i = F.col("_i")
    trend = (
        F.when(F.col("_t").isNotNull(), F.col("_t"))
        .when(i < first, F.col("_hs") * i + F.col("_hc"))
        .when(i > last, F.col("_es") * i + F.col("_ec"))
    )
    base = base.withColumn("trend", trend)
    additive = model == "additive"
    detrended = x - F.col("trend") if additive else ratio(x, F.col("trend"))
    phase = Window.partitionBy(*keys, "_phase")
    base = (
        base.withColumn("_phase", F.col("_i") % period)
        .withColumn("_d", detrended)
        .withColumn("_pm", F.avg("_d").over(phase))
    )
    # The first ``period`` rows hold each phase mean once.
    centre = F.avg(F.when(F.col("_i") < period, F.col("_pm"))).over(whole)
    seasonal = F.col("_pm") - centre if additive else ratio(F.col("_pm"), centre)
    base = base.withColumn("seasonal", seasonal)
    residual = F.col("_d") - F.col("seasonal") if additive else ratio(F.col("_d"), F.col("seasonal"))
    return base.withColumn("residual", residual).select(*keys, "ts", "observed", "trend", "seasonal", "residual")


def summary(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Trend change and strength, seasonal strength and range, residual figures."""
    var_r, var_s = F.var_samp("residual"), F.var_samp("seasonal")
    detrended = F.var_samp(F.col("observed") - F.col("trend"))
    known = F.when(F.col("trend").isNotNull(), F.col("ts"))
    start, end = F.min_by("trend", known), F.max_by("trend", known)
    return (
        parts.groupBy(*keys)
        .agg(
            start.alias("start_value"), end.alias("end_value"),
            var_r.alias("_r"), var_s.alias("_s"), detrended.alias("_d"),
            F.max("seasonal").alias("max_effect"), F.min("seasonal").alias("min_effect"),
            F.avg("residual").alias("residual_mean"), F.stddev_samp("residual").alias("residual_std"),
            F.max("residual").alias("residual_max"), F.min("residual").alias("residual_min"),
        )
        .withColumn("change_percent", ratio(F.col("end_value") - F.col("start_value"), F.col("start_value")) * 100)
        .withColumn("direction", F.when(F.col("change_percent") > 0, "increasing").otherwise("decreasing"))
        .withColumn("seasonal_strength", F.greatest(F.lit(0.0), 1 - ratio(F.col("_r"), F.col("_s") + F.col("_r"))))
        .withColumn(
            "trend_strength",
            F.when(F.col("_d") > 0, F.greatest(F.lit(0.0), 1 - ratio(F.col("_r"), F.col("_d")))).otherwise(F.lit(0.0)),
        )
        .withColumn("seasonal_range", F.col("max_effect") - F.col("min_effect"))
        .drop("_r", "_s", "_d")
    )


def seasonal_profile(parts: DataFrame, keys: list[str], part: str = "hour") -> DataFrame:
    """Mean and deviation of the seasonal and observed values per hour or weekday."""
    label = {"hour": F.hour("ts"), "weekday": F.weekday("ts")}[part]
    aggs = []
    for c in ("seasonal", "observed"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return parts.groupBy(*keys, label.alias(part)).agg(*aggs)


def _autocovariance_sums(df: DataFrame, keys: list[str], column: str, lags: int) -> DataFrame:
    """Per series: n, mean and the list of Σ (x_t - m)(x_{t+k} - m) for k = 0..lags."""
    known = df.filter(F.col(column).isNotNull())
    whole = Window.partitionBy(*keys)
    ordered = whole.orderBy("ts")
    centred = known.withColumn("_x", F.col(column) - F.avg(column).over(whole))
    shifted = centred.select(
        *keys, "_x", *[F.lead("_x", k).over(ordered).alias(f"_l{k}") for k in range(1, lags + 1)]
    )
    products = [F.sum(F.col("_x") * F.col("_x"))] + [F.sum(F.col("_x") * F.col(f"_l{k}")) for k in range(1, lags + 1)]
    return shifted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("_sums"))


def acf(df: DataFrame, keys: list[str], column: str = "volume", lags: int = 48) -> DataFrame:
    """Autocorrelation by lag with the ±1.96 / √n band."""
    sums = _autocovariance_sums(df, keys, column, lags)
    listed = sums.select(*keys, "n", F.col("_sums")[0].alias("_s0"), F.posexplode("_sums").alias("lag", "_s"))
    return listed.filter(F.col("_s").isNotNull()).select(
        *keys, "lag", ratio(F.col("_s"), F.col("_s0")).alias("acf"), (F.lit(1.96) / F.sqrt("n")).alias("band")
    )


def _levinson(r: Column) -> Column:
    """Partial autocorrelations of lags 0, 1, … from autocovariances (Durbin–Levinson).

    A fold over the lags; its state are the coefficients of the last order, the variance
    they leave, and the results so far. NULL from where no variance is left.
    """
    nothing = F.struct(
        F.array().cast("array<double>").alias("phi"), F.get(r, F.lit(0)).alias("left"), F.array(F.lit(1.0)).alias("found")
    )

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        pairs = F.zip_with(phi, F.reverse(F.slice(r, F.lit(2), k - 1)), lambda p, q: p * q)
        explained = F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y)

        def grown(a: Column) -> Column:
            return F.struct(
                F.array_append(F.zip_with(phi, F.reverse(phi), lambda p, q: p - a * q), a).alias("phi"),
                (state["left"] * (1 - a * a)).alias("left"),
                F.array_append(state["found"], a).alias("found"),
            )

        return bind(ratio(F.get(r, k) - explained, state["left"]), grown)

    orders = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: k > 0)
    return F.aggregate(orders, nothing, step, lambda state: state["found"])


def pacf(df: DataFrame, keys: list[str], column: str = "volume", lags: int = 48) -> DataFrame:
    """Partial autocorrelation by lag from bias-adjusted autocovariances.

    The sums over the series are built by Spark; the recursion is an expression over
    at most ``lags + 1`` of them per series.
    """
    sums = _autocovariance_sums(df, keys, column, lags)
    known = F.filter("_sums", lambda s: s.isNotNull() & ~F.isnan(s))
    adjusted = F.transform(known, lambda s, k: s / (F.col("n") - k))
    solved = sums.select(*keys, "n", adjusted.alias("_r")).select(*keys, "n", _levinson(F.col("_r")).alias("_p"))
    return solved.select(
        *keys, (F.lit(1.96) / F.sqrt("n")).alias("band"), F.posexplode("_p").alias("lag", "pacf")
    ).select(*keys, "lag", "pacf", "band")


# Response surface of the critical values (constant, one series)
# and of the p-value of the Dickey–Fuller statistic, as published by MacKinnon.
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
P_MAX, P_MIN, P_STAR = 2.74, -18.83, -1.61
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def critical_value(level: str, n: int) -> float:
    return sum(b / n**k for k, b in enumerate(CRITICAL[level]))


def df_p_value(stat: float) -> float:
    if stat > P_MAX:
        return 1.0
    if stat < P_MIN:
        return 0.0
    coefs = P_SMALL if stat <= P_STAR else P_LARGE
    z = sum(c * stat**k for k, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def longest_lag(n: Column, max_lags: int | None) -> Column:
    """The most lags a series of n values is tested with; below 0 it is not tested."""
    rule = F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))) if max_lags is None else F.lit(max_lags)
    return F.least(rule, F.floor(n / 2) - 2).cast("int")


def _chosen_lag(products: np.ndarray, n: int, limit: int) -> int:
    """Number of lags of least AIC, all on the same rows: one sweep per further lag."""
    best, chosen = np.inf, 0
    a = products
    for k in range(limit + 2):  # constant, level, and one lag after the other
        if a[k, k] <= 1e-10 * max(products[k, k], 1e-300):
            break  # this variable, and so each longer regression, adds nothing
        a = sweep(a, k)
        left = a[-1, -1]
        if k >= 1 and left > 0:
            aic = n * (np.log(2 * np.pi) + np.log(left / n) + 1) + 2 * (k + 1)
            if aic < best:
                best, chosen = aic, k - 1
    return chosen


def _level_statistic(products: np.ndarray, n: int, lags: int) -> float:
    """t statistic of the level in the regression with so many lags."""
    a = products
    for k in range(lags + 2):
        if a[k, k] <= 1e-10 * max(products[k, k], 1e-300):
            return np.nan
        a = sweep(a, k)
    left = a[-1, -1] / (n - lags - 2) if n > lags + 2 else 0.0
    return float(a[-1, 1] / np.sqrt(-a[1, 1] * left)) if left > 0 else np.nan


def stationarity(df: DataFrame, keys: list[str], column: str = "volume", max_lags: int | None = None) -> DataFrame:
    """Augmented Dickey–Fuller test per series, lag count by AIC.

    All regressions of a series come from one matrix of products of the level, the lagged
    differences and the next difference, which Spark sums over the rows; the few rows at its
    begin, which only the regressions of fewer lags have, are kept apart. Series that are
    constant or too short have no row.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("ts")
    x = F.col("_x")
    known = df.filter(F.col(column).isNotNull()).select(*keys, "ts", F.col(column).cast("double").alias("_x"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(longest_lag(F.col("n"), max_lags))).first()[0]  # as wide as the longest series needs
    most = max(0, most or 0)
    shifted = {f"_{k}": F.lag("_x", k).over(w) for k in range(1, most + 1)} | {"_next": F.lead("_x").over(w)}
    rows = known.withColumns(
        shifted | {"_t": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole), "_varied": F.min("_x").over(whole) < F.max("_x").over(whole)}
    )
    at = [x, *(F.col(f"_{k}") for k in range(1, most + 1))]
    differences = [F.coalesce(a - b, F.lit(0.0)) for a, b in zip(at, at[1:])]
    vector = F.array(F.lit(1.0), x, *differences, F.col("_next") - x)
    limit = longest_lag(F.col("_n"), max_lags)
    placed = rows.filter(F.col("_next").isNotNull() & F.col("_varied") & (limit >= 0)).select(
        *keys, F.col("_n").alias("size"), limit.alias("limit"), F.col("_t").alias("t"), vector.alias("v")
    )
    by = [*keys, "size", "limit"]
    width = most + 3
    sums = cross_products(placed.filter("t >= limit").select(*by, "v"), by, width, lambda rows: np.stack(rows["v"]))
    begin = placed.filter("t < limit").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("begin"))
    met = sums.join(begin.select(*keys, "begin"), keys, "left") if keys else sums.crossJoin(F.broadcast(begin.select("begin")))
    names = ["statistic", "p_value", "n_lags", "n", "critical_1", "critical_5", "critical_10", "is_stationary"]
    kinds = ["double", "double", "int", "int", "double", "double", "double", "boolean"]
    schema = types_of(df, keys, *(f"{n} {k}" for n, k in zip(names, kinds)))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                products, n, limit = matrix(np.asarray(row["sums"])), row["n"], row["limit"]
                used = [0, 1, *range(2, limit + 2), width - 1]
                lags = _chosen_lag(products[np.ix_(used, used)], n, limit)
                early = row["begin"] if row["begin"] is not None else []
                more = np.array([b["v"] for b in early if b["t"] >= lags]).reshape(-1, width)
                used = [0, 1, *range(2, lags + 2), width - 1]
                stat = _level_statistic((products + more.T @ more)[np.ix_(used, used)], n + len(more), lags)
                p = df_p_value(stat)
                values = [stat, p, lags, row["size"], *(critical_value(k, n + len(more)) for k in CRITICAL), bool(p < 0.05)]
                out.append([*(row[k] for k in keys), *values])
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])

    return met.mapInPandas(test, schema)
