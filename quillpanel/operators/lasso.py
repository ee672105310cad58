"""Lasso paths from Gram sums, for several training sets (folds) at once.

One pass adds up, for every fold and every cross-validation block of it, the products of all columns. Everything after that (scaling, the whole path of penalties for
each left-out block, its errors, the final fit) works on matrices of (features + 2) squared at the driver; the rows are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Line:
    """A linear model on raw features."""

    features: list[str]
    weights: np.ndarray
    intercept: float
    penalty: float


def blocks(train: DataFrame, target: str, count: int) -> DataFrame:
    """train with block: each fold's rows in order of date and symbol cut into `count` contiguous blocks whose sizes differ by one at most, the larger first.

    A row's place is the number of rows on earlier dates plus its place on its date, so only small tables of dates are sorted whole. A date within a block needs no places:
    rows are sorted, and shuffled, only on dates that a border of blocks cuts.
    """
    rows = train.where(F.col(target).isNotNull())
    days = rows.groupBy("fold", "date").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("fold")
    days = days.select(F.col("fold").alias("_f"), F.col("date").alias("_d"), (F.sum("_n").over(whole.orderBy("date")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_all"), "_n")
    small, extra = F.floor(F.col("_all") / count), F.col("_all") % count

    def block(at: Column) -> Column:
        return F.when(at < extra * (small + 1), F.floor(at / (small + 1))).otherwise(extra + F.floor((at - extra * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")

    days = days.withColumns({"_first": block(F.col("_before")), "_last": block(F.col("_before") + F.col("_n") - 1)})
    dated = rows.join(F.broadcast(days), (F.col("fold") == F.col("_f")) & F.col("date").eqNullSafe(F.col("_d")))
    place = F.row_number().over(Window.partitionBy("fold", "date").orderBy("symbol")) - 1
    cut = dated.where("_first <> _last").withColumn("_place", place).withColumn("block", block(F.col("_before") + F.col("_place"))).drop("_place")
    return dated.where("_first = _last").withColumn("block", F.col("_first")).unionByName(cut).drop("_f", "_d", "_before", "_all", "_n", "_first", "_last")


def gram_sums(rows: DataFrame, columns: list[str], shift: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """(fold, block): the sums of products of (1, columns less shift). Tasks add up before the shuffle; at most folds x blocks x (columns + 1)^2 numbers come to the driver."""
    k = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])])
            x[:, 1:] -= shift
            x = np.nan_to_num(x)  # a missing value counts as the mean
            of = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]], axis=1)
            for key in np.unique(of, axis=0):
                part = x[(of == key).all(axis=1)]
                at = tuple(key.tolist())
                sums[at] = sums.get(at, 0) + part.T @ part
        for (f, b), m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, v, np.int32)) for v in (f, b)] + [pa.array(np.arange(k * k, dtype=np.int32)), pa.array(m.ravel())], names=["fold", "block", "i", "v"])

    narrow = rows.select("fold", "block", *(F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(columns)))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in narrow.mapInArrow(run, "fold int, block int, i int, v double").groupBy("fold", "block", "i").agg(F.sum("v").alias("v")).toArrow().to_pylist():
        out.setdefault((r["fold"], r["block"]), np.zeros(k * k))[r["i"]] = r["v"]
    return {key: v.reshape(k, k) for key, v in out.items()}


def centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Gram sums of (1, x, y): the covariance sums of (x, y), and their means."""
    n = max(m[0, 0], 1.0)
    return m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n, m[0, 1:] / n, n


def descend(xx: np.ndarray, xy: np.ndarray, penalty: float, w: np.ndarray, tolerance: float = 1e-10, sweeps: int = 10_000) -> np.ndarray:
    """Minimises w'xx w / 2 - xy'w + penalty |w| by coordinate descent from w; columns without variance stay at 0."""
    w, slope = w.copy(), xx @ w
    live = np.flatnonzero(np.diag(xx) > 1e-12)
    for _ in range(sweeps):
        largest = 0.0
        for j in live:
            old = w[j]
            push = xy[j] - slope[j] + xx[j, j] * old
            new = np.sign(push) * max(abs(push) - penalty, 0.0) / xx[j, j]
            if new != old:
                slope += xx[:, j] * (new - old)
                w[j] = new
                largest = max(largest, abs(new - old))
        if largest < tolerance:
            break
    return w


def path(top: float, count: int, span: float) -> np.ndarray:
    """Penalties from the least that leaves no weight down to `span` of it, evenly on a log scale."""
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * span, count) if count > 1 else np.array([max(top, 1e-12)])


def choose(parts: list[np.ndarray], penalties: int, span: float) -> tuple[np.ndarray, float, float, float]:
    """Weights, intercept (both on the shifted columns), penalty and its mean error from the Gram sums of a training set's blocks.

    Columns are scaled by the whole set's spread. A penalty's error is the mean over the left-out blocks of their mean squared error; the largest penalty wins a tie.
    """
    whole = sum(parts)
    cov, mean, n = centred(whole)
    k = len(cov) - 1
    scale = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0))
    scale = np.where(scale > 1e-12, scale, 1.0)
    xx, xy = cov[:k, :k] / np.outer(scale, scale) / n, cov[:k, k] / scale / n
    grid = path(float(np.abs(xy).max(initial=0.0)), penalties, span)
    errors = np.zeros(len(grid))
    used = [p for p in parts if p[0, 0] > 0 and whole[0, 0] > p[0, 0]]
    for p in used:
        c, m, size = centred(whole - p)
        a, b, w = c[:k, :k] / np.outer(scale, scale) / size, c[:k, k] / scale / size, np.zeros(k)
        for i, penalty in enumerate(grid):
            w = descend(a, b, penalty, w)
            line = np.concatenate(([-(m[k] - (w / scale) @ m[:k])], -w / scale, [1.0]))  # residual = y - intercept - x w
            errors[i] += line @ p @ line / p[0, 0] / len(used)
    best = int(np.argmin(np.round(errors, 12)))
    w = np.zeros(k)
    for penalty in grid[: best + 1]:
        w = descend(xx, xy, penalty, w)
    return w / scale, float(mean[k] - (w / scale) @ mean[:k]), float(grid[best]), float(errors[best])


def fit(train: DataFrame, features: dict[int, list[str]], target: str, folds: int = 5, penalties: int = 100, span: float = 1e-3) -> dict[int, Line]:
    """A lasso for each fold (column `fold`) of train, its penalty chosen over contiguous blocks of rows. A missing feature counts as its mean over all training rows; a fold without rows gives 0."""
    names = list(dict.fromkeys(c for f in features.values() for c in f))
    rows = train.where(F.col(target).isNotNull())
    means = rows.agg(*(F.avg(f"`{c}`") for c in [*names, target])).first()  # the shift only keeps the sums well conditioned
    shift = np.array([float(v or 0.0) for v in means])
    sums = gram_sums(blocks(train, target, folds), [*names, target], shift)
    out = {}
    for f, mine in features.items():
        keep = [0, *(1 + names.index(c) for c in mine), len(names) + 1]
        parts = [m[np.ix_(keep, keep)] for (fold, _), m in sorted(sums.items()) if fold == f]
        if not parts:
            out[f] = Line(mine, np.zeros(len(mine)), 0.0, 0.0)
            continue
        w, intercept, penalty, _ = choose(parts, penalties, span)
        at = [names.index(c) for c in mine]
        out[f] = Line(mine, w, intercept + float(shift[-1] - w @ shift[at]), penalty)
    return out


def predict(test: DataFrame, lines: dict[int, Line]) -> DataFrame:
    """test (with fold) and pred_score, as column expressions; NULL where a used feature is missing or the fold is unknown."""
    score = F.lit(None).cast("double")
    for f, line in lines.items():
        value = F.lit(line.intercept)
        for c, w in zip(line.features, line.weights.tolist(), strict=True):
            value = value + F.col(f"`{c}`").cast("double") * w
        score = F.when(F.col("fold") == f, value).otherwise(score)
    return test.withColumn("pred_score", score)
