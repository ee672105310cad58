"""Functions over the rows of a symbol, in order of date. Frames count rows. A result needs `least` non-null inputs in its frame, all by default."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def order():
    """Built on use: window specs need a session."""
    return Window.partitionBy("symbol").orderBy("date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(n: int):
    return order().rowsBetween(-(n - 1), 0)


def delay(x: str | Column, n: int) -> Column:
    return F.lag(col(x), n).over(order())


def ahead(x: str | Column, n: int) -> Column:
    return F.lead(col(x), n).over(order())


def delta(x: str | Column, n: int) -> Column:
    return col(x) - delay(x, n)


def roll(fn: Callable[[Column], Column], x: str | Column, n: int, least: int | None = None) -> Column:
    x = col(x)
    return F.when(F.count(x).over(frame(n)) >= (n if least is None else least), fn(x).over(frame(n)))


def mean(x, n, least=None):
    return roll(F.avg, x, n, least)


def total(x, n, least=None):
    return roll(F.sum, x, n, least)


def std(x, n, least=None):
    return roll(F.stddev_samp, x, n, least)


def lowest(x, n, least=None):
    return roll(F.min, x, n, least)


def highest(x, n, least=None):
    return roll(F.max, x, n, least)


def skew(x: str | Column, n: int, least: int | None = None) -> Column:
    """Bias-corrected; NULL below three values or without variance."""
    x, k = col(x), F.count(col(x)).over(frame(n))
    factor = F.when(k >= 3, F.sqrt(k * (k - 1)) / F.nullif(k - 2, F.lit(0)))
    return F.when(k >= (n if least is None else least), F.skewness(x).over(frame(n)) * factor)


def _paired(x, y) -> tuple[Column, Column]:
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.when(both, col(x)), F.when(both, col(y))


def cov(x, y, n: int, least: int | None = None) -> Column:
    a, b = _paired(x, y)
    return F.when(F.count(a).over(frame(n)) >= (n if least is None else least), F.covar_samp(a, b).over(frame(n)))


def corr(x, y, n: int, least: int | None = None) -> Column:
    """NULL where either side is constant; plain corr() would raise there."""
    a, b = _paired(x, y)
    spread = F.stddev_samp(a).over(frame(n)) * F.stddev_samp(b).over(frame(n))
    return F.when(F.count(a).over(frame(n)) >= (n if least is None else least), F.try_divide(F.covar_samp(a, b).over(frame(n)), spread))


def beta(x, market, n: int, least: int | None = None, eps: float = 1e-8) -> Column:
    m = col(market)
    variance = F.when(F.count(m).over(frame(n)) >= (n if least is None else least), F.var_samp(m).over(frame(n)))
    return cov(x, market, n, least) / (variance + eps)


def rank(x: str | Column, n: int, least: int | None = None) -> Column:
    """Share of the frame at or below the current value, ties counted half: pandas' rolling rank as a share."""
    x = col(x)
    values = F.collect_list(x).over(frame(n))
    below, equal = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return F.when((F.size(values) >= (n if least is None else least)) & x.isNotNull(), (below + (equal + 1) / 2) / F.size(values))


def argmax(x: str | Column, n: int) -> Column:
    """1-based place of the first largest value, from the frame's start."""
    values = F.collect_list(col(x)).over(frame(n))
    return F.when(F.size(values) >= n, F.array_position(values, F.array_max(values)))


def ratio(x, y) -> Column:
    return F.try_divide(col(x), col(y))


def log_ratio(x, y) -> Column:
    return F.ln(ratio(x, y))


YEAR = math.sqrt(252)
