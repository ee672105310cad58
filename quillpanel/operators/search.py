"""Symbolic search of factors: expression trees bred by tournaments, a whole generation scored in one pass.

Trees are small tuples at the driver. The training rows are packed once, a row for each date; in a pass every task evaluates all trees of a generation on its dates (shared
subtrees once) and sends five sums for each tree. Trees that win become columns, so a found factor runs as an ordinary expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.sources.market import Scratch

#: (name, left, right), the number of a feature, or a constant (a float).
Tree = tuple | int | float
NAMES = ("add", "sub", "mul", "div")


@dataclass(frozen=True)
class Settings:
    """metric: pearson over all rows, or rank_ic, the mean of daily rank correlations; both count by their size, less `simple` for each node of a tree."""

    generations: int = 20
    population: int = 1000
    components: int = 15
    fame: int = 100
    tournament: int = 20
    depth: tuple[int, int] = (2, 6)
    crossover: float = 0.9
    mutation: float = 0.03
    share: float = 0.5
    simple: float = 0.001
    metric: str = "pearson"
    seed: int = 42


def grown(rng: np.random.Generator, features: int, depth: int, full: bool) -> Tree:
    if depth == 0 or (not full and rng.random() < features / (features + len(NAMES))):
        return int(rng.integers(features)) if rng.random() < 0.9 else float(np.round(rng.uniform(-1, 1), 3))
    return (NAMES[rng.integers(len(NAMES))], grown(rng, features, depth - 1, full), grown(rng, features, depth - 1, full))


def size(t: Tree) -> int:
    return 1 + size(t[1]) + size(t[2]) if isinstance(t, tuple) else 1


def part(t: Tree, n: int) -> Tree:
    """The n-th subtree, in order of writing."""
    if n == 0:
        return t
    left = size(t[1])
    return part(t[1], n - 1) if n <= left else part(t[2], n - 1 - left)


def swapped(t: Tree, n: int, new: Tree) -> Tree:
    if n == 0:
        return new
    left = size(t[1])
    return (t[0], swapped(t[1], n - 1, new), t[2]) if n <= left else (t[0], t[1], swapped(t[2], n - 1 - left, new))


def value(t: Tree, x: np.ndarray, known: dict) -> np.ndarray:
    """On columns x. A division by almost nothing gives 1; results are held within 1e12."""
    if isinstance(t, int):
        return x[:, t]
    if isinstance(t, float):
        return np.full(len(x), t)
    if t not in known:
        a, b = value(t[1], x, known), value(t[2], x, known)
        with np.errstate(all="ignore"):
            out = a + b if t[0] == "add" else a - b if t[0] == "sub" else a * b if t[0] == "mul" else np.where(np.abs(b) > 0.001, a / np.where(np.abs(b) > 0.001, b, 1.0), 1.0)
        known[t] = np.clip(np.nan_to_num(out), -1e12, 1e12)
    return known[t]


def column(t: Tree, features: list[str]) -> Column:
    if isinstance(t, int):
        return F.coalesce(F.nanvl(F.col(f"`{features[t]}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    if isinstance(t, float):
        return F.lit(t)
    a, b = column(t[1], features), column(t[2], features)
    out = a + b if t[0] == "add" else a - b if t[0] == "sub" else a * b if t[0] == "mul" else F.when(F.abs(b) > 0.001, F.try_divide(a, b)).otherwise(1.0)
    return F.least(F.greatest(out, F.lit(-1e12)), F.lit(1e12))


def pack(train: DataFrame, features: list[str], target: str, scratch: Scratch) -> DataFrame:
    """date, n, x (missing values are 0), y (the date's centred rank of the target) and key, as bytes; rows without a target are left out."""
    rows = train.where(F.col(target).isNotNull()).select("date", "symbol", F.xxhash64("symbol", "date").alias("_key"), F.col(target).cast("double").alias("_y"), *(F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)))

    def run(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("symbol", kind="stable")
        x = np.nan_to_num(day[[f"_x{i}" for i in range(len(features))]].to_numpy(np.float64, na_value=np.nan))
        y = day["_y"].round(10).rank(pct=True).to_numpy() - 0.5
        return pd.DataFrame({"date": day["date"].iloc[:1].to_numpy(), "n": [len(day)], "x": [x.tobytes()], "y": [y.tobytes()], "key": [day["_key"].to_numpy(np.int64).tobytes()]})

    return scratch.saved(rows.groupBy("date").applyInPandas(run, f"date {dict(train.dtypes)['date']}, n long, x binary, y binary, key binary"), "search-packed")


def slices(x: np.ndarray, *more: np.ndarray, rows: int = 2048) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of a date's rows: all shared subtrees of a generation are held for one run at a time, so memory does not grow with a date's symbols."""
    for i in range(0, len(x), rows):
        yield tuple(a[i : i + rows] for a in (x, *more))


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(np.round(x, 10)).rank().to_numpy()


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    spread = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / spread) if spread > 1e-12 else np.nan


def fitness(packed: DataFrame, trees: list[Tree], width: int, s: Settings, number: int = 0) -> np.ndarray:
    """The metric of each tree, on the generation's sample of rows, without the penalty for size."""
    held = packed.sparkSession.sparkContext.broadcast((trees, number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, number = held.value
        sums = np.zeros((len(trees), 6))
        for batch in batches:
            for row in batch.to_pylist():
                x, y, key = np.frombuffer(row["x"]).reshape(row["n"], width), np.frombuffer(row["y"]), np.frombuffer(row["key"], np.int64)
                some = ((key ^ (number * 7919)) * 48271 % 1_000_003) < s.share * 1_000_003
                x, y = x[some], y[some]
                if len(y) < 2:
                    continue
                if s.metric == "rank_ic":
                    placed = _ranks(y)
                    for k, t in enumerate(trees):
                        c = _corr(_ranks(value(t, x, {})), placed)  # ranks need the whole date, so nothing is kept from tree to tree
                        if c == c:
                            sums[k, :2] += c, 1
                    continue
                for xs, ys in slices(x, y):
                    known = {}
                    for k, t in enumerate(trees):
                        v = value(t, xs, known)
                        sums[k] += len(v), v.sum(), ys.sum(), v @ v, v @ ys, ys @ ys
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees), dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["k", *(f"s{i}" for i in range(6))])

    schema = "k int, " + ", ".join(f"s{i} double" for i in range(6))
    found = packed.mapInArrow(run, schema).groupBy("k").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(6))).orderBy("k").toArrow()
    held.destroy()
    a = np.stack([found.column(f"s{i}").to_numpy() for i in range(6)], axis=1) if len(found) else np.zeros((len(trees), 6))
    if s.metric == "rank_ic":
        out = np.divide(a[:, 0], a[:, 1], out=np.zeros(len(a)), where=a[:, 1] > 0)
    else:
        n = np.maximum(a[:, 0], 1)
        cov, vx, vy = a[:, 4] - a[:, 1] * a[:, 2] / n, a[:, 3] - a[:, 1] ** 2 / n, a[:, 5] - a[:, 2] ** 2 / n
        ok = (vx > 1e-9 * np.maximum(a[:, 3], 1e-30)) & (vy > 0)
        out = np.divide(cov, np.sqrt(np.where(ok, vx * vy, 1.0)), out=np.zeros(len(a)), where=ok)
    return np.round(np.nan_to_num(np.abs(out)), 9)


def bred(rng: np.random.Generator, trees: list[Tree], scores: np.ndarray, width: int, s: Settings) -> list[Tree]:
    """The next generation: winners of tournaments, crossed with winners, changed in a subtree, or as they are. No tree grows beyond 63 nodes."""
    worth = scores - s.simple * np.array([size(t) for t in trees])

    def winner() -> Tree:
        drawn = rng.integers(len(trees), size=s.tournament)
        return trees[drawn[np.argmax(worth[drawn])]]

    out = []
    while len(out) < s.population:
        t, chance = winner(), rng.random()
        n = int(rng.integers(size(t)))
        if chance < s.crossover:
            other = winner()
            t = swapped(t, n, part(other, int(rng.integers(size(other)))))
        elif chance < s.crossover + s.mutation:
            t = swapped(t, n, grown(rng, width, int(rng.integers(1, 4)), False))
        out.append(t if size(t) <= 63 else winner())
    return out


def mine(train: DataFrame, features: list[str], target: str, s: Settings | None = None) -> list[Tree]:
    """The least alike of the best trees: of the last generation's `fame` best by metric, the worse of the most correlated pair goes until `components` are left."""
    s = s or Settings()
    with Scratch(train.sparkSession) as scratch:
        return _bred_best(pack(train, features, target, scratch), features, s)


def _bred_best(packed: DataFrame, features: list[str], s: Settings) -> list[Tree]:
    rng, (low, high) = np.random.default_rng(s.seed), s.depth
    trees = [grown(rng, len(features), int(rng.integers(low, high + 1)), k % 2 == 0) for k in range(s.population)]
    for number in range(s.generations):
        scores = fitness(packed, trees, len(features), s, number)
        if number + 1 < s.generations:
            trees = bred(rng, trees, scores, len(features), s)
    order = sorted(range(len(trees)), key=lambda k: (-scores[k], size(trees[k]), str(trees[k])))
    best = list(dict.fromkeys(trees[k] for k in order))[: s.fame]
    alike = np.abs(correlations(packed, best, len(features)))
    np.fill_diagonal(alike, -1)
    left = list(range(len(best)))
    while len(left) > s.components:
        part_of = alike[np.ix_(left, left)]
        a, b = np.unravel_index(int(np.argmax(part_of)), part_of.shape)
        left.pop(max(a, b))  # the later one is the worse
    return [best[k] for k in left]


def correlations(packed: DataFrame, trees: list[Tree], width: int) -> np.ndarray:
    """Of the trees' values over all rows, from sums of products; constant ones have none (0)."""
    held = packed.sparkSession.sparkContext.broadcast(trees)
    k = len(trees) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            for row in batch.to_pylist():
                for (x,) in slices(np.frombuffer(row["x"]).reshape(row["n"], width)):
                    known = {}
                    v = np.column_stack([np.ones(len(x)), *(value(t, x, known) for t in held.value)])
                    sums += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "v"])

    found = packed.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    m = found.column("v").to_numpy().reshape(k, k) if len(found) else np.zeros((k, k))
    cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / max(m[0, 0], 1)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    return np.divide(cov, np.outer(spread, spread), out=np.zeros_like(cov), where=np.outer(spread, spread) > 1e-12)


def factors(panel: DataFrame, trees: list[Tree], features: list[str], prefix: str = "GP_Alpha_") -> DataFrame:
    return panel.withColumns({f"{prefix}{i}": column(t, features) for i, t in enumerate(trees)})
