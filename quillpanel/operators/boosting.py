"""Histogram boosting of shallow trees, for several training sets (folds) at once.

Features become bins by each fold's own quantiles, once; a row of the packed table holds one date of one fold. The dates are dealt evenly over the cores and kept there as
arrays. In a round every task routes its rows through the trees since the last margins and takes gradients once; what the round's sample needs is kept for its levels. A level is
one job of one stage: every task adds up (node, feature, bin) cells, a bounded number of which comes to the driver, which adds them and picks the splits of all folds. Gradients
are whole numbers of a fixed unit, so sums, and with them the trees, do not depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.sources.market import Scratch

#: A gradient or hessian is at most this many units, so that 2^33 rows add up within 63 bits and a batch within a double.
UNIT = 1 << 28


@dataclass(frozen=True)
class Settings:
    """loss: squared or ndcg (LambdaMART over the pairs that touch the `pairs` best of a date). ridge and lasso are the L2 and L1 penalties of leaves, least the hessian that a leaf needs."""

    loss: str = "squared"
    rounds: int = 150
    depth: int = 3
    rate: float = 0.03
    rows: float = 0.7
    columns: float = 0.6
    ridge: float = 5.0
    lasso: float = 1.0
    least: float = 5.0
    bins: int = 256
    pairs: int = 20
    seed: int = 42
    keep: int = 10  # margins are written anew after so many rounds


@dataclass
class Tree:
    """A full tree of fixed depth. Inner nodes are numbered from 1, the children of i are 2i and 2i + 1; a node that is not split sends all rows left."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int, bins: int) -> Tree:
        return cls(np.zeros(1 << depth, np.int64), np.full(1 << depth, bins, np.int64), np.zeros(1 << depth))

    def node(self, binned: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels. Each inner node's test is one comparison of a whole column of bins, kept as a contiguous row, and a row takes its node's bit."""
        columns, place = np.asfortranarray(binned).T, np.zeros(len(binned), np.uint8 if levels <= 8 else np.uint32)
        for level in range(levels):
            bit = np.zeros(len(place), np.uint8)
            for k in range(1 << level):
                i = (1 << level) + k
                if self.limit[i] < 255:  # no bin is above 255
                    right = columns[self.feature[i]] > np.uint8(self.limit[i])
                    bit |= (right & (place == k)).view(np.uint8) if level else right.view(np.uint8)
            place = (place << 1) | bit
        return place.astype(np.int64) + (1 << levels)


@dataclass
class Forest:
    base: float
    cuts: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """From raw values; a missing one counts as below all others."""
        return margins(binned(x, self.cuts), self.trees) + self.base


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin b holds what is above cut b - 1 and not above cut b."""
    x = np.where(np.isnan(x), -np.inf, x)
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1) if cuts else np.zeros((len(x), 0), np.int64)


def margins(b: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(len(b))
    b = np.asfortranarray(b)
    for t in trees:
        out += t.value[t.node(b, len(t.value).bit_length() - 1) - len(t.value)]
    return out


_DISCOUNTS = np.zeros(0)


def discounts(n: int) -> np.ndarray:
    """Of the first n places; a worker keeps the longest run it has made."""
    global _DISCOUNTS
    if len(_DISCOUNTS) < n:
        _DISCOUNTS = 1 / np.log2(np.arange(n) + 2)
    return _DISCOUNTS[:n]


def ideal_gain(y: np.ndarray) -> float:
    return max((np.sort(y)[::-1] * discounts(len(y))).sum(), 1e-12)


def ndcg_slopes(y: np.ndarray, s: np.ndarray, pairs: int, ideal: float | None = None, run: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """LambdaMART (Burges 2010) on one date: gradient and hessian of each row, over the pairs that touch the current best `pairs` rows, weighed by the swap's change of NDCG with linear gain.

    ideal: ideal_gain(y), where it is known. Rows are gone through `run` at a time, so that a run's arrays stay in the processor's cache; exponentials are taken once a row.
    """
    n, most = len(y), min(pairs, len(y))
    if not most:
        return np.zeros(n), np.zeros(n)
    order = np.argsort(-s, kind="stable")
    y, s, discount = y[order], s[order], discounts(n)
    below = np.exp(np.minimum(s[0] - s, 700.0))  # of the best row's score less each row's
    above, far = np.exp(np.maximum(s[:most] - s[0], -700.0))[:, None], s[0] - s[-1] > 50
    g, h, own_g, own_h = np.zeros(n), np.zeros(n), np.zeros(most), np.zeros(most)
    held = np.empty((3, most, run))
    for begin in range(0, n, run):
        part = slice(begin, min(begin + run, n))
        gain, worse, size = held[:, :, : part.stop - begin]
        np.subtract(y[:most, None], y[part], out=gain)
        gain *= np.subtract(discount[:most, None], discount[part], out=size)
        if begin < most:
            gain[np.arange(begin, part.stop) <= np.arange(most)[:, None]] = 0  # each pair once
        np.multiply(below[part], above, out=worse)
        if far:
            np.minimum(worse, math.exp(50), out=worse)
        worse += 1
        np.reciprocal(worse, out=worse)  # the chance that the lower row is the better one
        np.abs(gain, out=size)
        size *= worse
        np.minimum(gain, 0, out=gain)
        gain += size  # where the upper row is the worse one, its chance of being so is 1 - worse
        worse *= size
        size -= worse
        g[part], h[part] = np.add.reduce(gain, axis=0), np.add.reduce(size, axis=0)
        own_g += np.add.reduce(gain, axis=1)
        own_h += np.add.reduce(size, axis=1)
    g[:most] -= own_g
    h[:most] += own_h
    ideal = ideal_gain(y) if ideal is None else ideal
    out = np.empty(n), np.empty(n)
    out[0][order], out[1][order] = g / ideal, h / ideal
    return out


def drawn(keys: np.ndarray, number: int, share: float) -> np.ndarray:
    """Rows of a round's sample, by a mix of each row's hash with the round."""
    with np.errstate(over="ignore"):
        x = (keys.view(np.uint64) ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.float64) < share * 2**24


def units(x: np.ndarray, bound: float) -> np.ndarray:
    return np.clip(np.rint(x * (UNIT / bound)), -UNIT, UNIT)


def split(g: np.ndarray, h: np.ndarray, allowed: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """Best (gain, feature, bin) of one node's cells (feature by bin): rows up to the bin go left. The first in order of feature and bin wins a tie."""
    left_g, left_h = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
    total_g, total_h = left_g[:, -1:], left_h[:, -1:]
    worth = lambda a, b: np.maximum(np.abs(a) - s.lasso, 0) ** 2 / (b + s.ridge + 1e-12)
    gain = worth(left_g, left_h) + worth(total_g - left_g, total_h - left_h) - worth(total_g, total_h)
    fits = (left_h >= s.least) & (total_h - left_h >= s.least) & allowed[:, None]
    gain = np.where(fits, np.round(gain, 9), -1.0)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 0 else None


def leaf(g: float, h: float, s: Settings) -> float:
    return -math.copysign(max(abs(g) - s.lasso, 0.0), g) / (h + s.ridge + 1e-12) * s.rate


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers of the same order, and back."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def quantile_cuts(train: DataFrame, features: list[str], bins: int, kept: int = 24) -> dict[tuple[int, int], np.ndarray]:
    """(fold, number of a feature): the cuts between its bins, at most bins - 1, which share its values out evenly.

    Values are counted by the first `kept` bits of their order-preserving form (a relative step of 1 / 4096), so counts, and cuts, do not depend on how rows are dealt
    out; a cut is the largest double of its step. One pass for all folds and features; only the steps where a bin ends come to the driver.
    """
    drop, half = np.int64(64 - kept), np.int64(1 << (kept - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(len(features)):
                x = batch.column(i + 1).to_numpy(zero_copy_only=False).astype(np.float64)
                there = ~np.isnan(x)
                found, n = np.unique((fold[there].astype(np.int64) << kept) + (_ordered(x[there]) >> drop) + half, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found >> kept).astype(np.int32)), pa.array(np.full(len(n), i, np.int32)), pa.array((found & (2 * half - 1)) - half), pa.array(n.astype(np.int64))], names=["fold", "i", "step", "n"])

    counted = train.select("fold", *(F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features))).mapInArrow(count, "fold int, i int, step long, n long")
    counted = counted.groupBy("fold", "i", "step").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("fold", "i")
    counted = counted.withColumns({"up": F.sum("n").over(of.orderBy("step")), "all": F.sum("n").over(of)})
    ends = counted.where((F.floor(F.col("up") * bins / F.col("all")) > F.floor((F.col("up") - F.col("n")) * bins / F.col("all"))) & (F.col("up") < F.col("all")))
    out: dict[tuple[int, int], list[int]] = {}
    for r in ends.select("fold", "i", "step").collect():
        out.setdefault((r["fold"], r["i"]), []).append(r["step"])
    last = {}
    for key, steps in out.items():
        top = (np.sort(np.array(steps, np.int64)) << drop) | np.int64((1 << int(drop)) - 1)
        last[key] = np.where(top < 0, top ^ np.int64(2**63 - 1), top).view(np.float64)
    return last


def pack(train: DataFrame, features: list[str], target: str, cuts: dict[int, list[np.ndarray]], seed: int, scratch: Scratch) -> DataFrame:
    """fold, date, n, and as bytes: bins (feature by feature), y and keys (a hash of symbol and date) of the date's rows in order of symbol. A date's cross-section fits in a task.

    The dates are dealt over all cores: left to itself, Spark would join these few bytes to a handful of partitions, and every pass would run in as few tasks.
    """
    rows = train.where(F.col(target).isNotNull()).select("fold", "date", "symbol", F.xxhash64("symbol", "date", F.lit(seed)).alias("_key"), F.col(target).cast("double").alias("_y"), *(F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(features)))

    def run(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values(["symbol", "_key"], kind="stable")
        x = day[[f"_x{i}" for i in range(len(features))]].to_numpy(np.float64, na_value=np.nan)
        data = {"bins": binned(x, cuts[int(day["fold"].iloc[0])]).astype(np.uint8).T, "y": day["_y"].to_numpy(np.float64), "keys": day["_key"].to_numpy(np.int64)}
        return pd.DataFrame({"fold": day["fold"].iloc[:1].to_numpy(), "date": day["date"].iloc[:1].to_numpy(), "n": [len(day)], **{k: [v.tobytes()] for k, v in data.items()}})

    schema = f"fold int, date {dict(train.dtypes)['date']}, n long, bins binary, y binary, keys binary"
    parts = 2 * train.sparkSession.sparkContext.defaultParallelism
    return scratch.saved(rows.repartition(parts, "fold", "date").groupBy("fold", "date").applyInPandas(run, schema), "boosting-packed")


def dealt(packed: DataFrame) -> RDD:
    """(fold, bins, y, keys, margin, ideal gain) of each packed date, as arrays, kept in memory or on disk. The dates are dealt out by their rows in turn, so all tasks have about as many."""
    parts = packed.sparkSession.sparkContext.defaultParallelism
    days = sorted(((r["n"], r["fold"], r["date"]) for r in packed.select("n", "fold", "date").collect()), reverse=True)
    parts = max(1, min(parts, len(days)))
    turn = [*range(parts), *reversed(range(parts))]
    place = {(f, d): turn[i % len(turn)] for i, (_, f, d) in enumerate(days)}

    def arrays(r: tuple) -> tuple:
        f, bins, y, keys = r
        y = np.frombuffer(y, np.float64)
        return f, np.frombuffer(bins, np.uint8).reshape(-1, len(y)), y, np.frombuffer(keys, np.int64), np.zeros(len(y)), ideal_gain(y)

    rows = packed.select("fold", "date", "bins", "y", "keys").rdd.map(lambda r: ((r[0], r[1]), (r[0], bytes(r[2]), bytes(r[3]), bytes(r[4]))))
    return rows.partitionBy(parts, place.__getitem__).values().map(arrays).persist(StorageLevel.MEMORY_AND_DISK)


def slopes(rows: RDD, number: int, trees: dict[int, list[Tree]], base: dict[int, float], s: Settings, bound: float, bends: float) -> RDD:
    """fold, and of each date's rows in a round's sample bins, gradients and hessians in units (none for squared error, where all are 1). trees: those since the margins."""

    def run(row: tuple) -> tuple:
        f, b, y, keys, margin, ideal = row
        some = np.flatnonzero(drawn(keys, number, s.rows))
        margin = margin + margins(b.T, trees[f])
        if s.loss == "squared":
            g, h = units(margin[some] + base[f] - y[some], bound), np.zeros(0)
        else:
            g, h = (units(x[some], limit) for x, limit in zip(ndcg_slopes(y, margin, s.pairs, ideal), (bound, bends), strict=True))
        return f, np.take(b, some, axis=1), g.astype(np.int32), h.astype(np.int32)

    return rows.map(run)


def cells(sampled: RDD, level: int, state: dict[int, tuple[Tree, np.ndarray]], s: Settings) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Each fold's sums of gradients and of hessians in units, by node, feature in use and bin. state: each fold's tree so far, and the features in use."""

    def run(rows: Iterator[tuple]) -> Iterator[dict]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for f, b, g, h in rows:
            tree, used = state[f]
            if f not in sums:
                sums[f] = tuple(np.zeros((1 << level, len(used), s.bins), np.int64) for _ in range(2))
            node, size = (tree.node(b.T, level) - (1 << level)) * s.bins, s.bins << level
            g, h = g.astype(np.float64), h.astype(np.float64)
            for k, i in enumerate(used.tolist()):
                key = node + b[i]
                sums[f][0][:, k] += np.bincount(key, weights=g, minlength=size).astype(np.int64).reshape(-1, s.bins)
                n = np.bincount(key, minlength=size) * UNIT if s.loss == "squared" else np.bincount(key, weights=h, minlength=size).astype(np.int64)
                sums[f][1][:, k] += n.reshape(-1, s.bins)
        yield sums

    def add(a: dict, b: dict) -> dict:
        return a | {f: (a[f][0] + x[0], a[f][1] + x[1]) if f in a else x for f, x in b.items()}

    made = sampled.mapPartitions(run)
    return made.reduce(add) if made.getNumPartitions() <= 64 else made.treeReduce(add)  # many tasks' cells are added up before the driver


def fit(train: DataFrame, features: dict[int, list[str]], target: str, s: Settings) -> dict[int, Forest]:
    """A forest for each fold: train has fold (int), date, symbol, the target and all features; features names those that each fold may use.

    Rows without a target are left out, a fold without rows gives its base, 0. Missing features lie in the lowest bin. Cells at the driver: folds x 2^(depth-1) x features x bins at most.
    """
    names = list(dict.fromkeys(c for f in features.values() for c in f))
    folds, width = sorted(features), len(names)
    stats = {r["fold"]: r for r in train.where(F.col(target).isNotNull()).groupBy("fold").agg(F.avg(target).alias("mean"), F.min(target).alias("lo"), F.max(target).alias("hi")).collect()}
    if s.bins > 256:
        raise ValueError("a bin is one byte")
    found = quantile_cuts(train.where(F.col(target).isNotNull()), names, s.bins) if names else {}
    cuts = {f: [found.get((f, i), np.zeros(0)) for i in range(width)] for f in folds}
    base = {f: round(float(stats[f]["mean"] or 0.0), 9) if f in stats and s.loss == "squared" else 0.0 for f in folds}
    bound = max([1e-9, *(2 * (float(r["hi"]) - float(r["lo"])) for r in stats.values())]) if s.loss == "squared" else 64.0
    bends = 1.0 if s.loss == "squared" else 16.0
    forests = {f: Forest(base[f], cuts[f]) for f in folds}
    if not names or not stats:
        return forests
    with Scratch(train.sparkSession) as scratch:
        _boost(pack(train, names, target, cuts, s.seed, scratch), forests, features, names, bound, bends, s)
    return forests


def _boost(packed: DataFrame, forests: dict[int, Forest], features: dict[int, list[str]], names: list[str], bound: float, bends: float, s: Settings) -> None:
    """Adds the trees of all rounds to the forests."""
    folds, width, base = sorted(forests), len(names), {f: x.base for f, x in forests.items()}
    rows, old, since = dealt(packed), None, 0
    for number in range(s.rounds):
        new, allowed = {f: Tree.empty(s.depth, s.bins) for f in folds}, {}
        for f in folds:
            mine = [i for i, c in enumerate(names) if c in features[f]]
            rng = np.random.default_rng([s.seed, f, number])
            allowed[f] = np.isin(np.arange(width), rng.choice(mine, max(1, math.ceil(s.columns * len(mine))), replace=False)) if mine else np.zeros(width, bool)
        used = {f: np.flatnonzero(allowed[f]) for f in folds}
        sampled = slopes(rows, number, {f: forests[f].trees[since:] for f in folds}, base, s, bound, bends).persist(StorageLevel.MEMORY_AND_DISK)  # the first level makes it, the others read it
        for level in range(s.depth):
            found = cells(sampled, level, {f: (new[f], used[f]) for f in folds}, s)
            for f in folds:
                sums = [np.zeros((1 << level, width, s.bins)) for _ in range(2)]
                for x, total, b in zip(sums, found.get(f, ()), (bound, bends)):
                    x[:, used[f]] = total * (b / UNIT)
                grow(new[f], level, *sums, allowed[f], s)
        sampled.unpersist()
        if old:
            old.unpersist()  # by now the margins that were made of it are kept
            old = None
        for f in folds:
            forests[f].trees.append(new[f])
        if len(forests[folds[0]].trees) - since >= s.keep and number + 1 < s.rounds:
            old, rows, since = rows, _advanced(rows, {f: forests[f].trees[since:] for f in folds}), number + 1
    rows.unpersist()


def grow(tree: Tree, level: int, g: np.ndarray, h: np.ndarray, allowed: np.ndarray, s: Settings) -> None:
    """Splits the nodes of a level, and on the last level sets the leaves. A node that is not split passes its rows, and its value, to the left."""
    for k in range(1 << level):
        node = (1 << level) + k
        best = split(g[k], h[k], allowed, s)
        any_feature = int(np.argmax(allowed))
        total_g, total_h = float(g[k, any_feature].sum()), float(h[k, any_feature].sum())
        left_g, left_h = total_g, total_h
        if best:
            _, f, b = best
            tree.feature[node], tree.limit[node] = f, b
            left_g, left_h = float(g[k, f, : b + 1].sum()), float(h[k, f, : b + 1].sum())
        if level == s.depth - 1:
            tree.value[2 * k] = leaf(left_g, left_h, s)
            tree.value[2 * k + 1] = leaf(total_g - left_g, total_h - left_h, s) if best else 0.0


def _advanced(rows: RDD, trees: dict[int, list[Tree]]) -> RDD:
    """The rows with the trees' values in their margins, kept in place of the old: later passes route rows through later trees only. What a lost executor kept is made again from the packed table."""

    def run(row: tuple) -> tuple:
        f, b, y, keys, margin, ideal = row
        return f, b, y, keys, margin + margins(b.T, trees[f]), ideal

    return rows.map(run).persist(StorageLevel.MEMORY_AND_DISK)


def predict(test: DataFrame, forests: dict[int, Forest], features: dict[int, list[str]]) -> DataFrame:
    """test (with fold) and pred_score; a fold without a forest gives NULL."""
    names = list(dict.fromkeys(c for f in features.values() for c in f))
    held = test.sparkSession.sparkContext.broadcast(forests)

    @F.pandas_udf("double")
    def score(fold: pd.Series, x: pd.DataFrame) -> pd.Series:
        out = np.full(len(fold), np.nan)
        values = x.to_numpy(np.float64, na_value=np.nan)
        for f in fold.unique():
            if f in held.value:
                mine = (fold == f).to_numpy()
                out[mine] = held.value[f].predict(values[mine])
        return pd.Series(out)

    made = score("fold", F.struct(*(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names))))
    return test.withColumn("pred_score", F.nanvl(made, F.lit(None).cast("double")))
