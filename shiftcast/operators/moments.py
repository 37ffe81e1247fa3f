"""Sums of products over the rows of each series, and small systems solved with them.

The products of a vector's entries add up over any split of the rows: a task sums what it
holds, batch by batch, and Spark sums the tasks. So a regression needs no task that sees a
series whole, and what is solved afterwards is one small matrix per series, whose size
depends on the model and not on the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Series whose sums a task holds before it gives them out.
SERIES_AT_ONCE = 64
#: The partial sums of a series meet in groups of this number of tasks first.
GROUPS = 64


def types_of(df: DataFrame, keys: list[str], *more: str) -> str:
    """A schema of the key columns followed by ``more``."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"{k} {types[k]}" for k in keys), *more])


def cross_products(df: DataFrame, keys: list[str], width: int, vectors: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """One row per series: keys, n and ``sums``, the lower triangle row by row of the summed
    products of the vectors with themselves.

    ``vectors`` turns rows of one series into a matrix with a vector of ``width`` per row.
    """
    lower = np.tril_indices(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def given_out() -> pd.DataFrame:
            rows = [(*key, n, total[lower].tolist()) for key, (n, total) in held.items()]
            return pd.DataFrame(rows, columns=[*keys, "n", "sums"])

        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)] if len(pdf) else []
            for key, rows in groups:
                x = vectors(rows)
                n, total = held.get(key, (0, 0.0))
                held[key] = (n + len(x), total + x.T @ x)
                if len(held) >= SERIES_AT_ONCE:
                    yield given_out()
                    held.clear()
        if held:
            yield given_out()

    found = df.mapInPandas(partial, types_of(df, keys, "n bigint", "sums array<double>"))
    found = found.withColumn("_part", F.spark_partition_id() % GROUPS)
    zeros = F.array_repeat(F.lit(0.0), width * (width + 1) // 2)
    for by in ([*keys, "_part"], keys):
        summed = F.aggregate(F.collect_list("sums"), zeros, _add).alias("sums")
        found = found.groupBy(*by).agg(F.sum("n").alias("n"), summed)
    return found


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def matrix(sums: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a lower triangle."""
    width = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    out = np.zeros((width, width))
    out[np.tril_indices(width)] = sums
    return out + np.tril(out, -1).T


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """Sweeps out variable k: afterwards the last row and column hold the regression of the last
    variable on those swept, its corner their residual sum of squares, and minus the inverse of
    the products stands where both were swept."""
    row, pivot = a[k].copy(), a[k, k]
    out = a - np.outer(row, row) / pivot
    out[k], out[:, k] = row / pivot, row / pivot
    out[k, k] = -1 / pivot
    return out
