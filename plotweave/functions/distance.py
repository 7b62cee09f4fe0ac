"""Optimal string alignment distance, and pairs of close names from deletion neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def aligned(a: list[str], b: list[str], most: int | None = None) -> np.ndarray:
    """Distances of pairs of strings: insertions, deletions, replacements, and swaps of neighbours, of which no part is edited again.

    Pairs of equal lengths are one array, so each cell of the table is one operation for all of them.
    With `most`, only a band of that width is filled, and what is farther apart has most + 1.
    """
    out = np.zeros(len(a), np.int32)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        groups.setdefault((len(x), len(y)), []).append(k)
    for (m, n), rows in groups.items():
        if most is not None and abs(m - n) > most:
            out[rows] = most + 1
            continue
        x, y = (np.array([[ord(c) for c in s[k]] for k in rows], np.int32).reshape(len(rows), size) for s, size in ((a, m), (b, n)))
        out[rows] = _table(x, y, max(m, n) if most is None else most)
    return out


def _table(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
    rows, m, n = len(x), x.shape[1], y.shape[1]
    far = np.int32(band + 1)
    line = lambda: np.full((rows, n + 1), far, np.int32)
    before, last, now = line(), line(), line()
    last[:, : min(n, band) + 1] = np.arange(min(n, band) + 1)
    for i in range(1, m + 1):
        now = line()
        if i <= band:
            now[:, 0] = i
        for j in range(max(1, i - band), min(n, i + band) + 1):
            cost = last[:, j - 1] + (x[:, i - 1] != y[:, j - 1])
            cost = np.minimum(cost, np.minimum(last[:, j], now[:, j - 1]) + 1)
            if i > 1 and j > 1:
                swap = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                cost = np.where(swap, np.minimum(cost, before[:, j - 2] + (x[:, i - 1] != y[:, j - 1])), cost)
            now[:, j] = np.minimum(cost, far)
        before, last = last, now
    return last[:, n]


def osa(a: Column, b: Column, most: int | None = None) -> Column:
    """The distance of two names, null if either is; with `most`, most + 1 for all that are farther apart."""

    @pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = pd.Series([None] * len(x), index=x.index, dtype="Int32")
        out[known] = aligned(x[known].tolist(), y[known].tolist(), most)
        return out

    return run(a, b)


def deletions(name: Column, most: int) -> Column:
    """The name and all that is left of it without up to `most` of its characters."""
    every = F.array(name)
    for _ in range(most):
        shorter = F.flatten(F.transform(every, lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))).otherwise(F.array().cast("array<string>"))))
        every = F.array_distinct(F.concat(every, shorter))
    return every


def close_names(ours: DataFrame, theirs: DataFrame, most: int = 1, by: str | None = None) -> DataFrame:
    """x, y and distance (and `by`): pairs of a name of ours (x) and one of theirs (y) of a distance of `most` at most.

    Two names of that distance have a common rest if up to `most` characters of each are deleted
    (a swap is one deletion on either side), so candidates come from an equi join on rests, and the
    distance is counted for those alone. Names are compared once, however often they occur.
    """
    keys = [by] if by else []
    side = lambda df, c: df.where(F.col(c).isNotNull()).select(*keys, c).distinct().select(*keys, c, F.explode(deletions(F.col(c), most)).alias("rest"))
    met = side(ours, "x").join(side(theirs, "y"), [*keys, "rest"]).where(F.abs(F.length("x") - F.length("y")) <= most).select(*keys, "x", "y").distinct()
    return met.withColumn("distance", osa(F.col("x"), F.col("y"), most)).where(F.col("distance") <= most)
