"""Formulaic alphas on the lagged view of a panel. All of them share four exchanges: symbol, date, symbol, date.

A: what a date ranks or averages, from a symbol's rows. B: ranks and means of a date. C: all alphas, from a symbol's bars and B's columns. D: ranks of a date over those of C
that need one. Each is one Arrow kernel over a symbol's or a date's rows. C meets the bars where they lie, by symbol (Spark uses the panel's exchange again), so they do not travel
through A and B: only what a date ranks, its ranks as whole numbers and, last, the alphas do, in few bytes (`functions.compact`). Values are rounded before they are ranked, since
noise in the last bit would break ties.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructType

from quillpanel.functions import compact, kernel
from quillpanel.functions import rolling as w

DEFAULT = (
    "002 006 007 013 016 019 024 028 035 039 040 043 052 055 102 103 104 105 110 111 112 113 114 115 116 117 118"
).split()
OPTIONAL = ["201", "202"]

Columns = dict[str, np.ndarray]


class Lagged:
    """A symbol's bars of the row before, and the series of them that several alphas take, each computed once."""

    def __init__(self, rows: Columns):
        self.o, self.h, self.l, self.c, self.v = (w.lag(rows[x], 1) for x in ("open", "high", "low", "close", "volume"))

    def logs(self, n: int, m: int) -> np.ndarray:
        """ln of the close n rows back over that m rows back."""
        return w.log_ratio(w.lag(self.c, n), w.lag(self.c, m))

    dlr = cached_property(lambda b: w.delta(w.ln(b.c), 1))
    r = cached_property(lambda b: w.ratio(b.c, w.lag(b.c, 1)) - 1)
    r21 = cached_property(lambda b: b.logs(0, 21))
    r252 = cached_property(lambda b: b.logs(0, 252))
    m20c = cached_property(lambda b: w.mean(b.c, 20))
    m20v = cached_property(lambda b: w.mean(b.v, 20))
    m20v10 = cached_property(lambda b: w.mean(b.v, 20, 10))
    m100c = cached_property(lambda b: w.mean(b.c, 100))


def _momentum(x: np.ndarray) -> np.ndarray:
    return w.delta(x, 21) / (np.abs(w.lag(x, 21)) + 0.001)


def _place(b: Lagged) -> np.ndarray:
    low, high = kernel.lowest(63, 30)(b.l), kernel.highest(63, 30)(b.h)
    return (b.c - low) / (high - low + 1e-8)


#: What stage A computes for B.
CROSSED: dict[str, Callable[[Lagged], np.ndarray]] = {
    "r": lambda b: b.r, "r21": lambda b: b.r21, "x2a": lambda b: w.delta(w.ln(b.v + 1), 7), "x2b": lambda b: (b.c - b.o) / (b.o + 0.001), "x13a": lambda b: w.log_ratio(b.c, b.m20c),
    "x13b": lambda b: w.ln((b.v + 1) / (b.m20v + 1)), "x16a": lambda b: w.log_ratio(b.h, b.m20c), "x252": lambda b: b.r252, "x28a": lambda b: w.corr(b.m20v, b.l, 21),
    "x28b": lambda b: w.ln((b.h + b.l) / 2 / b.c), "x39": lambda b: w.mean(b.v / (b.m20v10 + 1), 21, 10), "x40": lambda b: w.std(w.ln(b.h), 21, 5), "x52": lambda b: b.logs(21, 252),
    "x55": _place, "x55v": lambda b: b.v,
}

#: What stage B ranks within each date for each alpha, and what it takes besides.
RANKED = {"002": ["x2a", "x2b"], "013": ["x13a", "x13b"], "016": ["x16a", "x13b"], "019": ["x252"], "028": ["x28a", "x28b"], "039": ["x39", "x252"], "040": ["x40"], "052": ["x52"], "055": ["x55", "x55v"]}
BESIDES = {"039": ["r21"], "104": ["r"], "202": ["r"]}
#: Ranked within the date once more, with the sign turned.
LAST = ("013", "016")


def _a007(b: Lagged, _: Columns) -> np.ndarray:
    k = kernel.rank(60, 10)(np.round(np.abs(b.r21), 10))
    return np.where(np.isnan(k), np.nan, np.where(b.v > b.m20v, -k * np.sign(b.r21), 0.0))


def _a024(b: Lagged, _: Columns) -> np.ndarray:
    before = w.lag(b.m100c, 100)
    rise = w.ratio(b.m100c - before, w.lag(b.c, 100) + 0.001)
    return np.where(np.isnan(before) | np.isnan(b.m100c), np.nan, np.where(rise <= 0.05, -w.log_ratio(b.c, kernel.lowest(100)(b.c)), -b.r21))


def _a035(b: Lagged, _: Columns) -> np.ndarray:
    return kernel.rank(32)(b.v) * (1 - kernel.rank(16)(np.round(b.c + b.h - b.l, 10))) * (1 - kernel.rank(32)(np.round(b.dlr, 10)))


def _a052(b: Lagged, day: Columns) -> np.ndarray:
    low = kernel.lowest(21)(b.l)
    return w.log_ratio(w.lag(low, 21), low) * kernel.rank(21)(b.v) * day["R_x52"]


def _a114(b: Lagged, _: Columns) -> np.ndarray:
    share = lambda hit: w.mean(np.where(np.isnan(b.r), np.nan, hit), 252, 126)
    return -np.sign(b.r252) * (share(b.r < 0) - share(b.r > 0))


#: Stage C: each alpha from a symbol's bars and the columns of stage B.
FINAL: dict[str, Callable[[Lagged, Columns], np.ndarray]] = {
    "002": lambda b, day: -w.corr(day["R_x2a"], day["R_x2b"], 21),
    "006": lambda b, _: -w.corr(b.o, b.v, 21),
    "007": _a007,
    "013": lambda b, day: w.cov(day["R_x13a"], day["R_x13b"], 21),
    "016": lambda b, day: w.cov(day["R_x16a"], day["R_x13b"], 21),
    "019": lambda b, day: -np.sign(b.r21) * (1 + day["R_x252"]),
    "024": _a024,
    "028": lambda b, day: day["R_x28a"] + day["R_x28b"],
    "035": _a035,
    "039": lambda b, day: -day["R_039"] * (1 + day["R_x252"]),
    "040": lambda b, day: -day["R_x40"] * w.corr(b.h, b.v, 21),
    "043": lambda b, _: kernel.rank(63)(np.round(b.v / (b.m20v + 1), 10)) * kernel.rank(63)(np.round(-w.delta(b.c, 21), 10)),
    "052": _a052,
    "055": lambda b, day: -w.corr(day["R_x55"], day["R_x55v"], 21),
    "102": lambda b, _: w.ln(b.c) - 2 * w.ln(w.lag(b.c, 21)) + w.ln(w.lag(b.c, 42)),
    "103": lambda b, _: b.c / (kernel.highest(252, 60)(b.c) + 0.001) - 1,
    "104": lambda b, day: -w.beta(b.r, day["mkt"], 60, 20),
    "105": lambda b, _: b.logs(21, 252),
    "110": lambda b, _: -kernel.highest(21)(b.dlr),
    "111": lambda b, _: -w.skew(b.dlr, 63),
    "112": lambda b, _: b.logs(126, 252),
    "113": lambda b, _: b.logs(21, 126) / (w.std(b.dlr, 126, 63) * math.sqrt(105) + 1e-8),
    "114": _a114,
    "115": lambda b, _: w.mean(w.log_ratio(b.o, w.lag(b.c, 1)), 21, 10),
    "116": lambda b, _: w.mean((b.c - b.l - (b.h - b.c)) / (b.h - b.l + 1e-8), 21, 10),
    "117": lambda b, _: w.ln((w.mean(b.v, 21, 10) + 1) / (w.mean(b.v, 252, 126) + 1)),
    "118": lambda b, _: -np.sqrt(w.mean(w.log_ratio(b.h, b.l) ** 2, 21, 10) / (4 * math.log(2))),
    "201": lambda b, _: _momentum(b.c) * _momentum(b.v),
    "202": lambda b, day: w.total(b.r - day["mkt"], 252, 60) - w.total(b.r - day["mkt"], 21, 10),
}


def crossing(names: list[str]) -> list[str]:
    """The columns that stage A makes for these alphas."""
    return list(dict.fromkeys(x for n in names for x in [*RANKED.get(n, []), *BESIDES.get(n, [])]))


def day_columns(names: list[str]) -> list[str]:
    """The columns that stage B makes of them."""
    ranked = dict.fromkeys(x for n in names for x in RANKED.get(n, []))
    return [*(f"R_{x}" for x in ranked if x != "x39"), *(["R_039"] if "039" in names else []), *(["mkt"] if {"104", "202"} & set(names) else [])]


def day_rank(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Average-tie rank over the count of values, of the mask's rows."""
    return pd.Series(np.where(mask, np.round(x, 10), np.nan)).rank(pct=True).to_numpy()


def of_day(x: Columns, mask: np.ndarray, names: list[str]) -> Columns:
    """Stage B on one date."""
    made = {f"R_{k}": day_rank(x[k], mask) for k in dict.fromkeys(k for n in names for k in RANKED.get(n, []))}
    if "039" in names:
        made["R_039"] = day_rank(x["r21"] * (1 - made.pop("R_x39")), mask)
    if {"104", "202"} & set(names):
        r = x["r"][mask & ~np.isnan(x["r"])]
        made["mkt"] = np.full(len(mask), r.mean() if len(r) else np.nan)
    return made


def arrays(rows: pa.Table, columns: list[str]) -> Columns:
    """Columns as doubles, NaN where missing."""
    return {c: rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns}


def with_arrays(rows: pa.Table, columns: Columns) -> pa.Table:
    """rows with the columns; NaN is NULL."""
    for c, x in columns.items():
        rows = rows.append_column(c, pa.array(x, pa.float64(), from_pandas=True))
    return rows


def schema_with(fields: list, columns: list[str]) -> StructType:
    out = StructType([*fields])
    for c in columns:
        out = out.add(c, DoubleType())
    return out


def masked(rows: pa.Table) -> np.ndarray:
    return rows.column("is_liquid").to_numpy(zero_copy_only=False).astype(bool)


def kinds(crossed: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Of stage A's columns those that are only ranked, so rounded; volumes, which are whole numbers as a rule; those that are needed to the last bit."""
    exact = {c for besides in BESIDES.values() for c in besides}
    return [c for c in crossed if c not in exact and c != "x55v"], [c for c in crossed if c == "x55v"], [c for c in crossed if c in exact]


def sent(x: Columns, crossed: list[str]) -> dict[str, pa.Array]:
    """Stage A's columns in few bytes."""
    n = len(next(iter(x.values())))
    stack = lambda names: np.column_stack([np.zeros((n, 0)), *(x[c] for c in names)])
    ranked, volumes, exact = map(stack, kinds(crossed))
    return {"_ranked": compact.squeeze(np.round(ranked, 10), 10), "_volumes": compact.squeeze(np.round(volumes, 10), 0), "_exact": compact.binary(exact)}


def received(rows: pa.Table, crossed: list[str]) -> Columns:
    """The columns of sent()."""
    ranked, volumes, exact = kinds(crossed)
    out = dict(zip(ranked, compact.stretch(rows.column("_ranked"), len(ranked), 10).T, strict=True)) | dict(zip(volumes, compact.stretch(rows.column("_volumes"), len(volumes), 0).T, strict=True))
    return out | (dict(zip(exact, compact.plain(rows.column("_exact"), np.float64).T, strict=True)) if exact else {})


def ranks_sent(made: Columns, day: list[str]) -> tuple[pa.Array, pa.Array]:
    """Stage B's columns: twice each rank, a whole number, and what is the same for all of the date's rows: how many are ranked, and the market's return."""
    ranks = [c for c in day if c != "mkt"]
    n = len(next(iter(made.values())))
    x = np.column_stack([made[c] for c in ranks]) if ranks else np.zeros((n, 0))
    counts = (~np.isnan(x)).sum(axis=0)
    same = np.append(counts.astype(np.float64), [made["mkt"][0]] if "mkt" in day else [])
    return compact.squeeze(np.rint(x * counts * 2), 0), compact.binary(np.tile(same, (n, 1)))


def ranks_met(rows: pa.Table, day: list[str]) -> Columns:
    """The columns of ranks_sent()."""
    ranks = [c for c in day if c != "mkt"]
    same, twice = compact.plain(rows.column("_same"), np.float64), compact.stretch(rows.column("_ranks"), len(ranks), 0)
    return {c: w.ratio(twice[:, i] / 2, same[:, i]) for i, c in enumerate(ranks)} | ({"mkt": same[:, -1]} if "mkt" in day else {})


def generate(panel: DataFrame, names: list[str] | None = None, prefix: str = "WQ_Alpha_", digits: int | None = None, shift: float = 0.0) -> DataFrame:
    """symbol, date and a column for each alpha; the 27 default ones unless named. Rows that is_liquid masks are not ranked, but stay. A symbol's history, and a date's cross-section, must fit in a task.

    digits: alphas that are not ranked last are rounded to so many, after the shift, before they travel. The panel is read twice, by symbol; it has one row for a symbol and date.
    """
    names = names or DEFAULT
    bars = ["open", "high", "low", "close", "volume"]
    mask = F.coalesce("is_liquid", F.lit(False)) if "is_liquid" in panel.columns else F.lit(True)
    table = panel.select("symbol", "date", mask.alias("is_liquid"), *(F.col(x).cast("double").alias(x) for x in bars))
    base, crossed, day = table.schema.fields[:3], crossing(names), day_columns(names)
    last, free = [n for n in LAST if n in names], [n for n in names if n not in LAST]
    keys = ["symbol", "date", "is_liquid"]

    def before(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        b = Lagged(arrays(rows, bars))
        rows = rows.select(keys)
        for c, x in sent({x: CROSSED[x](b) for x in crossed}, crossed).items():
            rows = rows.append_column(c, x)
        return rows

    def across(rows: pa.Table) -> pa.Table:
        ranks, same = ranks_sent(of_day(received(rows, crossed), masked(rows), names), day)
        return rows.select(keys[:2]).append_column("_ranks", ranks).append_column("_same", same)

    def finished(rows: pa.Table, given: Columns) -> pa.Table:
        b = Lagged(arrays(rows, bars))
        made = {n: FINAL[n](b, given) for n in names}
        if digits is not None:
            made |= {n: np.round(made[n] + shift, digits) for n in free}
        rows = rows.select(keys)
        if not last:
            return with_arrays(rows, {f"{prefix}{n}": made[n] for n in names})
        rows = rows.append_column("_last", compact.squeeze(np.column_stack([np.round(made[n], 10) for n in last]), 10))
        return rows.append_column("_free", compact.squeeze(np.column_stack([made[n] for n in free]), digits or 0)) if free else rows

    def after(rows: pa.Table) -> pa.Table:
        return finished(rows.sort_by("date"), {})

    def met(rows: pa.Table, ranks: pa.Table) -> pa.Table:
        return finished(rows.sort_by("date"), ranks_met(ranks.sort_by("date"), day))

    def ranked(rows: pa.Table) -> pa.Table:
        x = dict(zip(last, compact.stretch(rows.column("_last"), len(last), 10).T, strict=True))
        made = {n: -day_rank(v, masked(rows)) for n, v in x.items()}
        if free:
            made |= dict(zip(free, compact.stretch(rows.column("_free"), len(free), digits or 0).T, strict=True))
        return with_arrays(rows.select(keys[:2]), {f"{prefix}{n}": made[n] for n in names})

    def fields(kept: list, *columns: str) -> StructType:
        out = StructType([*kept])
        for c in columns:
            out = out.add(c, BinaryType())
        return out

    through = fields(base, "_last", *(["_free"] if free else [])) if last else schema_with(base, [f"{prefix}{n}" for n in names])
    if crossed:
        found = table.groupBy("symbol").applyInArrow(before, fields(base, "_ranked", "_volumes", "_exact")).groupBy("date").applyInArrow(across, fields(base[:2], "_ranks", "_same"))
        made = table.groupBy("symbol").cogroup(found.groupBy("symbol")).applyInArrow(met, through)
    else:
        made = table.groupBy("symbol").applyInArrow(after, through)
    return made.groupBy("date").applyInArrow(ranked, schema_with(base[:2], [f"{prefix}{n}" for n in names])) if last else made.drop("is_liquid")


def ranked_last(table: DataFrame, columns: list[str]) -> DataFrame:
    """Stage D: the columns become their ranks within the date, with the sign turned."""

    def run(rows: pa.Table) -> pa.Table:
        for c in columns:
            rows = rows.set_column(rows.column_names.index(c), c, pa.array(-day_rank(arrays(rows, [c])[c], masked(rows)), pa.float64(), from_pandas=True))
        return rows

    return table.groupBy("date").applyInArrow(run, table.schema) if columns else table


def distinct_columns(table: DataFrame, columns: list[str]) -> list[str]:
    """The columns without those whose contents repeat an earlier one's, by a hash over all rows."""
    sums = table.agg(*(F.sum(F.xxhash64("symbol", "date", F.round(c, 10)).cast("decimal(38,0)")).alias(c) for c in columns)).first()
    seen: set = set()
    return [c for c in columns if not (sums[c] in seen or seen.add(sums[c]))]
