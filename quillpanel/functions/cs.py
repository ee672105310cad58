"""Functions over the rows of a date."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def per_date():
    """Built on use: window specs need a session."""
    return Window.partitionBy("date")


def masked(x: Column, mask: Column | None) -> Column:
    return x if mask is None else F.when(mask, x)


def rank(x: str | Column, mask: Column | None = None, day=None) -> Column:
    """Average-tie rank over the count of values; NULL where x is NULL or masked. A rank needs one sort: the first place of a value and how many are up to it come from the same window."""
    day = day or per_date()
    x = masked(F.col(x) if isinstance(x, str) else x, mask)
    order = day.orderBy(x.asc_nulls_last())
    first, last = F.rank().over(order), F.count(x).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (first + last) / 2 / F.count(x).over(day))


def even(x: str | Column) -> Column:
    """x in whole units of its tenth digit: for an order in which values that differ by less are equal. F.round() would make a decimal of every value."""
    return F.rint((F.col(x) if isinstance(x, str) else x) * 1e10)


def places(x: np.ndarray) -> np.ndarray:
    """rank(even()) of the values of one date, as an array for kernels; NaN is a missing value and its rank."""
    out, there = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    _, at, n = np.unique(np.rint(x[there] * 1e10), return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    out[there] = ((2 * last - n + 1) / 2 / max(len(there), 1))[at]
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Over the places where both are known; None where a side is constant."""
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if len(x) < 2 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return None
    x, y = x - x.mean(), y - y.mean()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def mean(x: str | Column, mask: Column | None = None) -> Column:
    return F.avg(masked(F.col(x) if isinstance(x, str) else x, mask)).over(per_date())


def bucket(order: Column, x: Column, q: Column | int, day=None) -> Column:
    """Equal-frequency bucket from 0 of x ranked first-come by `order`, with linearly interpolated edges (not ntile)."""
    day = day or per_date()
    q = F.lit(q) if isinstance(q, int) else q
    n = F.count(x).over(day)
    at = F.row_number().over(day.orderBy(x.asc_nulls_last(), order))
    place = F.when(n > 1, F.greatest(F.ceil((at - 1) * q / F.nullif(n - 1, F.lit(0))), F.lit(1)) - 1).otherwise(0)
    return F.when(x.isNotNull(), place).cast("int")


def tick_size(price: Column) -> Column:
    return F.when(price < 10_000, 10).when(price < 50_000, 50).otherwise(100)


def ceiling_price(reference: Column, unit: float = 1.0, limit: float = 0.07) -> Column:
    """The day's highest price: the reference plus the limit, down to a tick of its size."""
    top = reference * unit * (1 + limit)
    return F.floor(F.round(top / tick_size(top), 9)) * tick_size(top) / unit
