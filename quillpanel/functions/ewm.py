"""Exponentially weighted averages of a symbol's rows. They are recursive over the whole history, so one grouped kernel computes all of them in one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quillpanel.functions import kernel


def decay(x: np.ndarray, alpha: float) -> np.ndarray:
    """adjust=False; leading gaps stay empty, an inner gap lets the old weight decay once for each row passed."""
    return kernel.decayed(alpha)(x)


def averages(panel: DataFrame, columns: dict[str, tuple[str, float]], key: str = "symbol") -> DataFrame:
    """Adds each named average: (source column, alpha), in order of date. A symbol's history must fit in a task: some thousand rows."""
    return kernel.along(panel, {name: (source, kernel.decayed(alpha)) for name, (source, alpha) in columns.items()}, key)


def span(n: int) -> float:
    return 2 / (n + 1)
