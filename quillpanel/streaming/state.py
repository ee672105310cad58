"""Flags and recursive averages that follow a stream of bars: each symbol keeps its last close and the state of its averages, so a new bar costs one row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillpanel.functions.ewm import span
from quillpanel.operators.features import AVERAGES

#: The store that this kind of state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAN = float("nan")


def step(value: float, weight: float, x: float, alpha: float) -> tuple[float, float]:
    """One row of a recursive average and the weight of what it holds: leading gaps leave it empty, an inner gap lets the weight decay."""
    if value != value:
        return x, 1.0
    weight *= 1 - alpha
    if x == x:
        value, weight = (weight * value + alpha * x) / (weight + alpha), 1.0
    return value, weight


class Bars(StatefulProcessor):
    """For each bar in order of date: its flags, the averages of closes up to the bar before, and RSI_14. A bar not after the last one is marked late and changes nothing."""

    SCHEMA = "symbol {symbol}, date date, f_nan boolean, f_bad_ohlc boolean, f_zero_vol boolean, f_big_move boolean, f_any boolean, late boolean, " + ", ".join(f"EMA_{n} double" for n in AVERAGES) + ", RSI_14 double"

    def __init__(self, move: float = 0.15):
        self.move = move
        self.alphas = [*(span(n) for n in AVERAGES), 1 / 14, 1 / 14]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("bars", "last date, close double, before double, value array<double>, weight array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        table = pd.concat(list(rows)).sort_values("date", kind="stable")
        state = self.held.get() if self.held.exists() else None
        empty = [None] * len(self.alphas)
        last, close, before, value, weight = state if state is not None else (None, None, None, empty, empty)
        number = lambda x: _NAN if x is None or x != x else float(x)
        close, before, value, weight = number(close), number(before), [number(v) for v in value], [number(v) for v in weight]
        out = []
        for bar in table.itertuples(index=False):
            o, h, lo, c, v = (number(x) for x in (bar.open, bar.high, bar.low, bar.close, bar.volume))
            nan, bad, zero = any(x != x for x in (o, h, lo, c, v)), h < lo or h < o or h < c or lo > o or lo > c or min(x if x == x else 1 for x in (o, h, lo, c)) <= 0, not v > 0
            if last is not None and bar.date <= last:
                out.append((key[0], bar.date, nan, bad, zero, None, None, True, *[None] * (len(AVERAGES) + 1)))
                continue
            move = close == close and close != 0 and abs(c / close - 1) > self.move
            change = close - before
            inputs = [close] * len(AVERAGES) + [max(change, 0.0) if change == change else _NAN, max(-change, 0.0) if change == change else _NAN]
            made = [step(*x) for x in zip(value, weight, inputs, self.alphas, strict=True)]
            value, weight = [m[0] for m in made], [m[1] for m in made]
            gain, loss = value[-2:]
            rsi = 100.0 if loss == 0 and gain > 0 else 100 - 100 / (1 + gain / loss) if loss else _NAN
            out.append((key[0], bar.date, nan, bad, zero, move, nan or bad or zero or move, False, *(None if x != x else x for x in [*value[:-2], rsi])))
            last, close, before = bar.date, c, close
        none = lambda x: None if math.isnan(x) else x
        self.held.update((last, none(close), none(before), [none(x) for x in value], [none(x) for x in weight]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.SCHEMA.split(", ")]).astype({c: object for c in ("f_big_move", "f_any")})


def follow(stream: DataFrame, move: float = 0.15) -> DataFrame:
    """A stream of bars (symbol, date, open, high, low, close, volume) with each bar's flags and averages. Bars of a symbol should come in order of date."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = Bars.SCHEMA.format(symbol=dict(stream.dtypes)["symbol"])
    return stream.groupBy("symbol").transformWithStateInPandas(Bars(move), schema, "Append", "None")
