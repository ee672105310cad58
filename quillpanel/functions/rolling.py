"""Windows of one symbol's values, as arrays: what `ts` gives as column functions, for kernels that compute many of them in one pass over the symbol. Missing is NaN.

Every frame is summed anew, as Spark's window functions do, so errors do not run along the rows, and a frame of equal values has no spread at all.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def lag(x: np.ndarray, n: int) -> np.ndarray:
    """The value n rows back; ahead for negative n."""
    out = np.full(len(x), np.nan)
    if n >= 0:
        out[n:] = x[: max(len(x) - n, 0)]
    else:
        out[:n] = x[-n:]
    return out


def delta(x: np.ndarray, n: int) -> np.ndarray:
    return x - lag(x, n)


def ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.full(len(x), np.nan), where=y != 0)


def ln(x: np.ndarray) -> np.ndarray:
    return np.log(x, out=np.full(len(x), np.nan), where=x > 0)


def log_ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ln(ratio(x, y))


def _frames(x: np.ndarray, n: int, fill: float) -> np.ndarray:
    return sliding_window_view(np.concatenate([np.full(n - 1, fill), x]), n)


def counts(there: np.ndarray, n: int) -> np.ndarray:
    up = np.cumsum(there)
    return up - np.concatenate([np.zeros(min(n, len(up)), up.dtype), up[: max(len(up) - n, 0)]])


def _at_least(k: np.ndarray, n: int, least: int | None, value: np.ndarray) -> np.ndarray:
    return np.where(k >= max(n if least is None else least, 1), value, np.nan)


def total(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    there = ~np.isnan(x)
    return _at_least(counts(there, n), n, least, _frames(np.where(there, x, 0.0), n, 0.0).sum(axis=1))


def mean(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    return total(x, n, least) / np.maximum(counts(~np.isnan(x), n), 1)


def _centred(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts, and each frame's values less their mean, 0 where missing. They are taken from the last known value first, so equal values leave exact zeros."""
    there = ~np.isnan(x)
    k = counts(there, n)
    last = x[np.maximum.accumulate(np.where(there, np.arange(len(x)), 0))] if len(x) else x
    frames = _frames(x, n, np.nan) - last[:, None]
    missing = np.isnan(frames)
    frames[missing] = 0.0
    frames -= (frames.sum(axis=1) / np.maximum(k, 1))[:, None]
    frames[missing] = 0.0
    return k, frames


def var(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    k, d = _centred(x, n)
    return _at_least(k, n, least, ratio((d * d).sum(axis=1), k - 1.0))


def std(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    return np.sqrt(var(x, n, least))


def skew(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """Bias-corrected; missing below three values or without variance."""
    k, d = _centred(x, n)
    square = d * d
    second, third = square.sum(axis=1), (square * d).sum(axis=1)
    factor = np.sqrt(k * (k - 1.0)) / np.where(k > 2, k - 2.0, np.nan)
    return _at_least(k, n, least, ratio(np.sqrt(k) * third, second**1.5) * factor)


def _paired(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = ~(np.isnan(x) | np.isnan(y))
    return np.where(both, x, np.nan), np.where(both, y, np.nan)


def cov(x: np.ndarray, y: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    a, b = _paired(x, y)
    (k, da), (_, db) = _centred(a, n), _centred(b, n)
    return _at_least(k, n, least, ratio((da * db).sum(axis=1), k - 1.0))


def corr(x: np.ndarray, y: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """Missing where either side is constant."""
    a, b = _paired(x, y)
    (k, da), (_, db) = _centred(a, n), _centred(b, n)
    spread = np.sqrt((da * da).sum(axis=1)) * np.sqrt((db * db).sum(axis=1))
    return _at_least(k, n, least, ratio((da * db).sum(axis=1), spread))


def beta(x: np.ndarray, market: np.ndarray, n: int, least: int | None = None, eps: float = 1e-8) -> np.ndarray:
    return cov(x, market, n, least) / (var(market, n, least) + eps)
