"""A settlement-aware top-k portfolio. The trading rule is a state machine over dates; a scenario is one task, and many scenarios run side by side.

Picks and the prices of ever-picked symbols are prepared relationally, so a task gets about k symbols for each rebalancing, not the panel.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.operators.joins import dates_match


class DateMismatch(ValueError):
    """Prices and predictions do not cover the same dates."""


# Entry filters as columns: a multiplier for what a buy order may spend.


def step(multiplier: float) -> Column:
    return F.lit(float(multiplier))


def ramp(column: str, floor: float, threshold: float, low: float = 0.0, high: float = 1.0) -> Column:
    """low at the floor and below, high at the threshold and above or where the value is missing, a line between."""
    if floor >= threshold:
        raise ValueError("floor lies below threshold")
    share = (F.col(column) - floor) / (threshold - floor)
    return F.coalesce(low + (high - low) * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(float(high)))


def filter_group(condition: str, *multipliers: Column) -> Column:
    """The product of the multipliers where the SQL condition holds, else 1."""
    product = F.lit(1.0)
    for m in multipliers:
        product = product * m
    return F.when(F.coalesce(F.expr(condition), F.lit(False)), product).otherwise(1.0)


def with_multiplier(table: DataFrame, groups: list[Column]) -> DataFrame:
    product = F.lit(1.0)
    for g in groups:
        product = product * g
    return table.withColumn("multiplier", product)


def picks(predictions: DataFrame, k: int, every: int = 21, rank_weighted: bool = False) -> DataFrame:
    """(date, symbol, weight, place) on each rebalancing date: the k best by score, ties by symbol, weighted alike or by score above the worst pick (alike if all tie)."""
    dates = predictions.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).where(F.col("_i") % every == 0)
    day = Window.partitionBy("date")
    chosen = predictions.join(F.broadcast(dates), "date").withColumn("_p", F.row_number().over(day.orderBy(F.desc_nulls_last("pred_score"), "symbol"))).where(F.col("_p") <= k)
    above = F.col("pred_score") - F.min("pred_score").over(day)
    weight = F.coalesce(F.try_divide(above, F.sum("_a").over(day)), 1 / F.count(F.lit(1)).over(day)) if rank_weighted else 1 / F.count(F.lit(1)).over(day)
    return chosen.withColumn("_a", above).select("date", "symbol", weight.alias("weight"), F.col("_p").alias("place"))


def random_picks(predictions: DataFrame, k: int, seed: int, every: int = 21) -> DataFrame:
    """The null hypothesis: k symbols by a hash of (seed, symbol, date)."""
    return picks(predictions.withColumn("pred_score", F.xxhash64(F.lit(seed), "symbol", "date").cast("double")), k, every)


@dataclass
class Rules:
    capital: float = 1e9
    unit: float = 1.0
    fee: float = 0.001
    tax: float = 0.001
    lot: int = 100
    settle: int = 3
    every: int = 21
    limit: float = 0.07


@dataclass
class Holding:
    available: int = 0
    pending: deque = field(default_factory=deque)  # [days left, shares]

    @property
    def shares(self) -> int:
        return self.available + sum(n for _, n in self.pending)

    def settle(self) -> None:
        for pack in self.pending:
            pack[0] -= 1
        while self.pending and self.pending[0][0] <= 0:
            self.available += self.pending.popleft()[1]


def ceiling(reference: float, rules: Rules) -> float:
    top = reference * rules.unit * (1 + rules.limit)
    tick = 10 if top < 10_000 else 50 if top < 50_000 else 100
    return math.floor(round(top / tick, 9)) * tick / rules.unit


def trade(prices: pd.DataFrame, plan: dict, multipliers: dict, rules: Rules) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Values by date, holdings by date, and orders that could not be filled. prices: date, symbol, close; plan: date to {symbol: weight}.

    Buy orders are placed in the plan's order. One without a trade today, or above its ceiling, does not fill and reserves no cash.
    """
    table = prices.pivot(index="date", columns="symbol", values="close").sort_index()
    today, last = table.to_numpy(float), table.ffill().to_numpy(float)
    column = {s: i for i, s in enumerate(table.columns)}
    cash, pending, held = rules.capital, deque(), {}
    values, holdings, skipped = [], [], []
    target: dict = {}
    for t, day in enumerate(table.index):
        worth = sum(h.shares * last[t, column[s]] * rules.unit for s, h in sorted(held.items()) if not np.isnan(last[t, column[s]]))
        values.append((day, cash + sum(x for _, x in pending) + worth))
        for pack in pending:
            pack[0] -= 1
        while pending and pending[0][0] <= 0:
            cash += pending.popleft()[1]
        for h in held.values():
            h.settle()
        before = values[-2][1] if len(values) > 1 else rules.capital
        if t % rules.every == 0:
            target = plan.get(day, {})
            for s in sorted(held):
                h, price = held[s], today[t, column[s]]
                if s not in target:
                    n = h.available
                else:
                    reference = last[t - 1, column[s]] if t else price
                    excess = h.shares * reference * rules.unit - before * target[s]
                    n = min(h.available, int(excess / (reference * rules.unit) // rules.lot) * rules.lot) if excess > 0 else 0
                if n <= 0:
                    continue
                if np.isnan(price):
                    skipped.append((day, s, "sell", "no trade"))
                    continue
                h.available -= n
                pending.append([rules.settle, n * price * rules.unit * (1 - rules.fee - rules.tax)])
            held = {s: h for s, h in held.items() if h.shares}
        if t >= rules.settle and (t - rules.settle) % rules.every == 0 and target:
            start, reserved = cash, 0.0
            for s, weight in target.items():
                price, reference = today[t, column[s]], last[t - 1, column[s]]
                if np.isnan(reference) or np.isnan(price):
                    skipped.append((day, s, "buy", "no reference" if np.isnan(reference) else "no trade"))
                    continue
                top = ceiling(reference, rules)
                if price > top:
                    skipped.append((day, s, "buy", "close above ceiling"))
                    continue
                owned = held[s].shares if s in held else 0
                short = (before * weight - owned * reference * rules.unit) * multipliers.get((day, s), 1.0)
                n = int(min(short / (reference * rules.unit), (start - reserved) / (top * rules.unit * (1 + rules.fee))) // rules.lot) * rules.lot
                if n <= 0:
                    continue
                reserved += n * top * rules.unit * (1 + rules.fee)
                cash -= n * price * rules.unit * (1 + rules.fee)
                held.setdefault(s, Holding()).pending.append([rules.settle, n])
        holdings += [(day, s, h.shares) for s, h in sorted(held.items())]
    return values, holdings, skipped


def simulate(panel: DataFrame, scenarios: DataFrame, rules: Rules | None = None, multipliers: DataFrame | None = None) -> DataFrame:
    """(scenario, kind, date, symbol, amount, note): kind `value`, `holding` or `skipped`.

    panel: symbol, date, close; scenarios: scenario, date, symbol, weight, place (1 the best; buys run from the worst pick to the best); multipliers: scenario, date,
    symbol, multiplier, which counts only on its own date.
    A scenario's task gets every date of the panel, but only the symbols that the scenario ever picks.
    """
    rules = rules or Rules()
    chosen = scenarios.select("scenario", "symbol").distinct()
    bars = panel.select("symbol", F.to_date("date").alias("date"), "close").join(chosen, "symbol").select("scenario", "date", "symbol", F.col("close").alias("x"), F.lit("close").alias("kind"), F.lit(0).alias("place"))
    dates = panel.select(F.to_date("date").alias("date")).distinct().join(F.broadcast(chosen.groupBy("scenario").agg(F.min("symbol").alias("symbol")))).select("scenario", "date", "symbol", F.lit(None).cast("double").alias("x"), F.lit("date").alias("kind"), F.lit(0).alias("place"))
    rows = bars.unionByName(dates).unionByName(scenarios.select("scenario", F.to_date("date").alias("date"), "symbol", F.col("weight").alias("x"), F.lit("weight").alias("kind"), "place"))
    if multipliers is not None:
        rows = rows.unionByName(multipliers.select("scenario", F.to_date("date").alias("date"), "symbol", F.col("multiplier").alias("x"), F.lit("multiplier").alias("kind"), F.lit(0).alias("place")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in rows.groupby("kind")}
        prices = part["close"].rename(columns={"x": "close"}).drop_duplicates(["date", "symbol"])
        idle = part["date"][~part["date"]["date"].isin(prices["date"])]
        prices = pd.concat([prices, idle.rename(columns={"x": "close"})])
        plan: dict = {}
        ordered = part["weight"].sort_values(["date", "place"], ascending=[True, False])
        for d, s, w in zip(*(ordered[c] for c in ("date", "symbol", "x")), strict=True):
            plan.setdefault(d, {})[s] = w
        several = part.get("multiplier")
        factor = {} if several is None else dict(zip(zip(several["date"], several["symbol"], strict=True), several["x"], strict=True))
        values, holdings, skipped = trade(prices, plan, factor, rules)
        out = [(key[0], "value", d, None, v, None) for d, v in values] + [(key[0], "holding", d, str(s), float(n), None) for d, s, n in holdings]
        out += [(key[0], "skipped", d, str(s), None, f"{side}: {why}") for d, s, side, why in skipped]
        return pd.DataFrame(out, columns=["scenario", "kind", "date", "symbol", "amount", "note"])

    return rows.groupBy("scenario").applyInPandas(run, "scenario string, kind string, date date, symbol string, amount double, note string")


def check_dates(prices: DataFrame, predictions: DataFrame) -> None:
    span = predictions.agg(F.min("date"), F.max("date")).first()
    if not dates_match(prices.where(F.col("date").between(*span)), predictions).isEmpty():
        raise DateMismatch("prices and predictions differ in their dates")
