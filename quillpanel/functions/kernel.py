"""Functions over the rows of a symbol that frames cannot give cheaply: order statistics of the last n rows and recursive averages, all in one Arrow pass over each symbol.

Sliding frames of `collect_list`, `min` or `max` go through a frame again for every row. Here a rank takes a sorted buffer (log n steps a row) and an extreme a monotone
queue (one step a row), so a window of a year costs little more than one of a week.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructType

#: From a symbol's values in order of date (NaN where missing) to as many results.
Along = Callable[[np.ndarray], np.ndarray]


def rank(n: int, least: int | None = None) -> Along:
    """Share of the last n rows' values at or below the current one, ties counted half; at least `least` values (all n by default)."""
    return lambda x: pd.Series(x).rolling(n, min_periods=n if least is None else least).rank(method="average", pct=True).to_numpy()


def highest(n: int, least: int | None = None) -> Along:
    return lambda x: pd.Series(x).rolling(n, min_periods=n if least is None else least).max().to_numpy()


def lowest(n: int, least: int | None = None) -> Along:
    return lambda x: pd.Series(x).rolling(n, min_periods=n if least is None else least).min().to_numpy()


def argmax(n: int) -> Along:
    """1-based place of the first largest of the last n values, counted from the earliest; all n must be there."""

    def run(x: np.ndarray) -> np.ndarray:
        out, queue, since = np.full(len(x), np.nan), deque(), 0  # places of values that no later one exceeds
        for i, v in enumerate(x.tolist()):
            if v != v:
                queue.clear()
                since = 0
                continue
            since += 1
            while queue and queue[-1][1] < v:
                queue.pop()
            queue.append((i, v))
            if queue[0][0] <= i - n:
                queue.popleft()
            if since >= n:
                out[i] = queue[0][0] - (i - n)
        return out

    return run


def decayed(alpha: float) -> Along:
    """Exponential average, adjust=False; leading gaps stay empty, an inner gap lets the old weight decay once for each row passed."""
    return lambda x: pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def along(panel: DataFrame, columns: dict[str, tuple[str, Along]], key: str = "symbol", order: str = "date") -> DataFrame:
    """panel with each named column: (source column, function). A missing result is NULL. A symbol's history must fit in a task: some thousand rows."""
    schema = StructType([*panel.schema.fields])
    for c in columns:
        schema = schema.add(c, DoubleType())

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(order)
        for name, (source, function) in columns.items():
            x = rows.column(source).to_numpy(zero_copy_only=False).astype(np.float64)
            rows = rows.append_column(name, pa.array(function(x), pa.float64(), from_pandas=True))
        return rows

    return panel.groupBy(key).applyInArrow(run, schema)
