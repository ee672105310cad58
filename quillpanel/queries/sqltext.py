"""Pieces of DuckDB SQL for the oracles, written independently of the Spark columns."""

from __future__ import annotations

import re

WALK = """
day AS (SELECT l_suppkey AS symbol, {date} AS date, sum(l_quantity) AS volume, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2),
walk AS (SELECT symbol, date, volume, round(100 * exp(sum((d - 0.05) / 5) OVER (PARTITION BY symbol ORDER BY date)), 6) AS close FROM day),
opened AS (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date), close) AS open FROM walk),
panel AS (SELECT symbol, date, open, round(1.005 * greatest(open, close) + 1.7e-9, 6) AS high, round(0.995 * least(open, close) + 1.7e-9, 6) AS low, close, volume FROM opened)"""
DAILY = WALK.format(date="CAST(l_shipdate AS DATE)")
WEEKLY = WALK.format(date="CAST(date_trunc('week', l_shipdate) AS DATE)")
TRADE = """
line AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, {'a': l_orderkey, 'b': l_linenumber, 'p': l_extendedprice / l_quantity} AS k, l_extendedprice / l_quantity AS p, l_quantity AS q FROM lineitem),
trade AS (SELECT symbol, date, min(k).p AS open, max(p) AS high, min(p) AS low, max(k).p AS close, sum(q) AS volume FROM line GROUP BY 1, 2)"""

S = "PARTITION BY symbol ORDER BY date"


def frame(n: int) -> str:
    return f"OVER ({S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({S})"


def lead(x: str, n: int) -> str:
    return f"lead({x}, {n}) OVER ({S})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif(({b}), 0))"


def lnr(a: str, b: str) -> str:
    return f"ln(CASE WHEN {div(a, b)} > 0 THEN {div(a, b)} END)"


def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {frame(n)} >= {n if least is None else least} THEN {fn}({x}) {frame(n)} END"


def pair(x: str, y: str) -> tuple[str, str]:
    ok = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    return f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"


def cov(x: str, y: str, n: int, least: int | None = None) -> str:
    a, b = pair(x, y)
    return f"CASE WHEN count({a}) {frame(n)} >= {n if least is None else least} THEN covar_samp({a}, {b}) {frame(n)} END"


def corr(x: str, y: str, n: int) -> str:
    a, b = pair(x, y)
    return f"CASE WHEN count({a}) {frame(n)} >= {n} THEN covar_samp({a}, {b}) {frame(n)} / nullif(stddev_samp({a}) {frame(n)} * stddev_samp({b}) {frame(n)}, 0) END"


def rank_in(x: str, n: int, least: int | None = None) -> str:
    vals = f"list({x}) FILTER (({x}) IS NOT NULL) {frame(n)}"
    return f"CASE WHEN ({x}) IS NOT NULL AND len({vals}) >= {n if least is None else least} THEN (len(list_filter({vals}, lambda q: q < {x})) + (len(list_filter({vals}, lambda q: q = {x})) + 1) / 2.0) / len({vals}) END"


def day_rank(x: str) -> str:
    d = "PARTITION BY date"
    return f"CASE WHEN ({x}) IS NOT NULL THEN (rank() OVER ({d} ORDER BY {x} ASC NULLS LAST) + count({x}) OVER ({d}) + 1 - rank() OVER ({d} ORDER BY {x} DESC NULLS LAST)) / 2.0 / count({x}) OVER ({d}) END"


def rnd(x: str, name: str, digits: int = 6) -> str:
    """Rounded off the halves that means of rounded inputs hit exactly, where the last bit would decide."""
    return f"round(CAST({x} AS DOUBLE) + 1.7e-9, {digits}) + 0.0 AS {name}"


def uses(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def with_stages(panel: str, *stages: tuple[str, list[str]], final: str) -> str:
    """WITH panel, then stages that each add columns to the one before, then the final SELECT."""
    return f"WITH {panel},\n" + ",\n".join(f"{name} AS ({body})" for name, body in stages) + "\n" + final


BUCKET = "CASE WHEN ({x}) IS NOT NULL THEN CAST(CASE WHEN count({x}) OVER (PARTITION BY date) > 1 THEN greatest(ceil((row_number() OVER (PARTITION BY date ORDER BY {x} ASC NULLS LAST, symbol) - 1) * ({q}) / CAST(count({x}) OVER (PARTITION BY date) - 1 AS DOUBLE)), 1) - 1 ELSE 0 END AS INT) END"
