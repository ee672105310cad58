"""Significance of paired daily differences: block sign flips, moving-block bootstraps, Holm's correction, autocorrelation.

Draws come from an integer hash of (seed, iteration, position), so any engine can repeat them. A series has a row for each date; it travels as one array to the
iterations, which are spread over tasks and need no join of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.operators.labels import by_date
from quillpanel.operators.metrics import top_k
from quillpanel.operators.selection import guarded_corr
from quillpanel.sources.market import saved

_P, _A = 2147483647, 48271


def draw(seed: int, iteration: Column, position: Column) -> Column:
    """A number from 0 to 2^31 - 2 for each triple."""
    h = (iteration * 1000003 + position * 7919 + seed) % _P
    for _ in range(3):
        h = (h * _A + 11) % _P
    return h


def topk_average(table: DataFrame, score: str, ret: str, k: int) -> DataFrame:
    return top_k(table.where(F.col(ret).isNotNull()), score, k).groupBy("date").agg(F.avg(ret).alias("avg"))


def universe_average(table: DataFrame, ret: str) -> DataFrame:
    return table.where(F.col(ret).isNotNull()).groupBy("date").agg(F.avg(ret).alias("avg"))


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, delta) of two daily averages on their common dates."""
    return a.select("date", F.col("avg").alias("_a")).join(b.select("date", F.col("avg").alias("_b")), "date").select("date", (F.col("_a") - F.col("_b")).alias("delta"))


def thin(series: DataFrame, step: int, offset: int = 0) -> DataFrame:
    """Every step-th row by date."""
    rows = series.withColumn("_n", F.row_number().over(by_date()) - 1 - offset)
    return rows.where((F.col("_n") >= 0) & (F.col("_n") % step == 0)).drop("_n")


def _series(series: DataFrame, x: str) -> DataFrame:
    """One row: the values in order of date."""
    return series.where(F.col(x).isNotNull()).agg(F.array_sort(F.collect_list(F.struct("date", x))).alias("s")).select(F.col(f"s.{x}").alias("v"), F.size("s").alias("n"))


def _iterations(series: DataFrame, n: int) -> DataFrame:
    spark = series.sparkSession
    return spark.range(0, n, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).join(F.broadcast(series))


def permutation_test(series: DataFrame, x: str = "delta", block: int = 21, iterations: int = 10_000, seed: int = 42, alternative: str = "two-sided") -> DataFrame:
    """One row (n_days, mean_delta, p_value): each block of positions flips its sign together; the last block may be short."""
    row = _series(series, x)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int")), lambda b: F.aggregate(F.slice("v", b * block + 1, block), F.lit(0.0), lambda a, y: a + y))
    row = row.select("n", sums.alias("b"), (F.aggregate("v", F.lit(0.0), lambda a, y: a + y) / F.col("n")).alias("mean"))
    flip = F.aggregate(F.sequence(F.lit(0), F.size("b") - 1), F.lit(0.0), lambda a, i: a + F.get("b", i) * (draw(seed, F.col("id"), i.cast("long")) % 2 * 2 - 1)) / F.col("n")
    eps = 1e-12
    hit = {"two-sided": F.abs("f") >= F.abs("mean") - eps, "greater": F.col("f") >= F.col("mean") - eps, "less": F.col("f") <= F.col("mean") + eps}[alternative]
    drawn = _iterations(row, iterations).select("n", "mean", flip.alias("f"))
    return drawn.agg(F.max("n").cast("long").alias("n_days"), F.max("mean").alias("mean_delta"), ((F.sum(hit.cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def bootstrap_ci(series: DataFrame, x: str = "delta", block: int = 21, iterations: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row (ci_lo, ci_hi) of the mean: blocks from drawn starts, put together and cut at the series' length; sums of blocks come from running sums."""
    row = _series(series, x)
    running = F.aggregate("v", F.array(F.lit(0.0)), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)))
    row = row.select("n", running.alias("p"))
    length = F.least(F.lit(block), F.col("n"))

    def piece(a: Column, i: Column) -> Column:
        start = (draw(seed, F.col("id"), i.cast("long")) % (F.col("n") - length + 1)).cast("int")
        return a + F.get("p", start + F.least(length, F.col("n") - i * length)) - F.get("p", start)

    mean = F.aggregate(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / length).cast("int")), F.lit(0.0), piece) / F.col("n")
    tail = (1 - level) / 2
    drawn = _iterations(row, iterations).select(mean.alias("m"))
    return drawn.agg(F.percentile("m", F.lit(tail)).alias("ci_lo"), F.percentile("m", F.lit(1 - tail)).alias("ci_hi"))


def compare(name: str, series: DataFrame, x: str = "delta", step: int = 1, offset: int = 0, block: int | None = None, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """A row of the result table: a thinned series needs no blocks, a daily one blocks of 21."""
    part = thin(series.where(F.col(x).isNotNull()), step, offset) if step > 1 else series
    block = block or (1 if step > 1 else 21)
    if block > part.count():
        raise ValueError("the block is longer than the series")
    test, naive, ci = permutation_test(part, x, block, iterations, seed), permutation_test(part, x, 1, iterations, seed), bootstrap_ci(part, x, block, iterations, seed)
    row = test.join(naive.select(F.col("p_value").alias("p_naive"))).join(ci)
    return row.select(F.lit(name).alias("comparison"), "mean_delta", "n_days", F.lit(block).alias("block"), "p_value", "p_naive", "ci_lo", "ci_hi")


def holm(table: DataFrame, p: str = "p_value", level: float = 0.05) -> DataFrame:
    """p_holm: the running maximum of (m - rank) p, at most 1. A family may be long: it is sorted by ranges, and only each range's size and maximum come to the driver."""
    placed = saved(table.orderBy(p, "comparison").withColumn("_at", F.monotonically_increasing_id()), "holm")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["k"]: r["count"] for r in placed.groupBy(part.alias("k")).count().collect()}
    m, before, begins = sum(sizes.values()), 0, []
    for k in sorted(sizes):
        begins.append((k, before))
        before += sizes[k]
    spark = table.sparkSession
    begins = F.broadcast(spark.createDataFrame(begins, "_k long, _before long"))
    stepped = placed.withColumn("_k0", part).join(begins, F.col("_k0") == F.col("_k")).withColumn("_s", (m - F.col("_before") - row) * F.col(p))
    tops = {r["_k"]: r["top"] for r in stepped.groupBy("_k").agg(F.max("_s").alias("top")).collect()}
    highest, earlier = 0.0, []
    for k in sorted(tops):
        earlier.append((k, float(highest)))
        highest = max(highest, tops[k])
    inside = F.max("_s").over(Window.partitionBy("_k").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    out = stepped.withColumn("_run", inside).join(F.broadcast(spark.createDataFrame(earlier, "_j long, _top double")), F.col("_k") == F.col("_j"))
    out = out.withColumn("p_holm", F.least(F.lit(1.0), F.greatest("_run", "_top"))).select(*table.columns, "p_holm")
    return out.withColumns({"significant": F.col(p) < level, "significant_holm": F.col("p_holm") < level})


def analyse(deltas: dict[str, DataFrame], **options) -> DataFrame:
    """A family of comparisons with Holm's correction."""
    rows = [compare(name, d, **options) for name, d in deltas.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return holm(out)


def offset_sensitivity(deltas: dict[str, DataFrame], step: int, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """Per comparison: least, median and largest p-value (sign flips of single rows) over the offsets of a thinned series, and the share below 0.05.

    All offsets of all comparisons are arrays of one small table, which every task of the iterations gets, so there is one job, not one for each offset.
    """
    series = None
    for name, d in deltas.items():
        rows = d.where(F.col("delta").isNotNull()).select(F.lit(name).alias("comparison"), "date", "delta", ((F.row_number().over(by_date()) - 1) % step).alias("offset"))
        series = rows if series is None else series.unionByName(rows)
    arrays = series.groupBy("comparison", "offset").agg(F.array_sort(F.collect_list(F.struct("date", "delta"))).alias("s")).select("comparison", "offset", F.col("s.delta").alias("v"), F.size("s").alias("n"))
    arrays = arrays.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, y: a + y) / F.col("n"))
    flip = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.lit(0.0), lambda a, i: a + F.get("v", i) * (draw(seed, F.col("id"), i.cast("long")) % 2 * 2 - 1)) / F.col("n")
    drawn = _iterations(arrays, iterations).select("comparison", "offset", (F.abs(flip) >= F.abs("mean") - 1e-12).cast("int").alias("hit"))
    p = drawn.groupBy("comparison", "offset").agg(((F.sum("hit") + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
    return p.groupBy("comparison").agg(F.min("p_value").alias("p_min"), F.median("p_value").alias("p_median"), F.max("p_value").alias("p_max"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("share_significant"))


def autocorrelation_table(deltas: dict[str, DataFrame], lags: int = 30) -> DataFrame:
    """A row for each comparison: n, the band, the effective n and the suggested block."""
    out = None
    for name, d in deltas.items():
        acf = autocorrelation(d, lags=lags)
        n = d.where(F.col("delta").isNotNull()).agg(F.count(F.lit(1)).alias("n"))
        row = n.join(acf.agg(F.max("band").alias("band"), (1 + 2 * F.sum(F.greatest("ac", F.lit(0.0)))).alias("_k"))).join(suggest_block(acf))
        row = row.select(F.lit(name).alias("comparison"), "n", "band", (F.col("n") / F.greatest(F.lit(1.0), "_k")).alias("n_eff"), "block")
        out = row if out is None else out.unionByName(row)
    return out


def autocorrelation(series: DataFrame, x: str = "delta", lags: int = 30) -> DataFrame:
    """(lag, ac, band): all lags in one pass; the band is 1.96 over the root of the length."""
    rows = series.where(F.col(x).isNotNull()).select(F.col(x).alias("x"), *(F.lag(x, k).over(by_date()).alias(f"l{k}") for k in range(1, lags + 1)))
    made = rows.agg(F.count("x").alias("n"), *(guarded_corr(F.col("x"), F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("ac")) for k in range(1, lags + 1)))).alias("e")
    return made.select("n", each).select("e.lag", "e.ac", (1.96 / F.sqrt("n")).alias("band"))


def effective_n(acf: DataFrame, n: int) -> DataFrame:
    return acf.agg((n / F.greatest(F.lit(1.0), 1 + 2 * F.sum(F.greatest("ac", F.lit(0.0))))).alias("n_eff"))


def suggest_block(acf: DataFrame, quiet: int = 3) -> DataFrame:
    """One row: the first lag of a run of `quiet` lags inside the band; the last lag if there is none."""
    inside = (F.abs("ac") < F.col("band")).cast("int")
    w = Window.orderBy("lag").rowsBetween(0, quiet - 1)
    rows = acf.select("lag", F.min(inside).over(w).alias("calm"), F.count(F.lit(1)).over(w).alias("k"))
    return rows.agg(F.coalesce(F.min(F.when((F.col("calm") == 1) & (F.col("k") == quiet), F.col("lag"))), F.max("lag")).alias("block"))


def sharpe(x: np.ndarray, rate: float = 0.0) -> np.ndarray:
    """Of the rows of a matrix of daily returns, yearly."""
    spread = x.std(axis=-1, ddof=1)
    return np.divide(x.mean(axis=-1) - rate / 252, spread, out=np.zeros(x.shape[:-1]), where=spread > 0) * math.sqrt(252)


def paired_returns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, a, b): daily returns of two value series (date, total_value), each along its own dates, on the dates that both have."""
    returns = lambda nav, name: nav.select("date", (F.try_divide("total_value", F.lag("total_value").over(by_date())) - 1).alias(name)).where(F.col(name).isNotNull())
    return returns(a, "a").join(returns(b, "b"), "date")


def sharpe_difference(returns: DataFrame, block: int = 21, iterations: int = 10_000, seed: int = 42) -> DataFrame:
    """One row from (date, a, b): difference of the Sharpe ratios, its bootstrap interval, and the p-value of the draws centred at their mean."""
    pairs = returns.dropna(subset=["a", "b"]).orderBy("date").select("a", "b").collect()  # a row for each date
    x = np.array(pairs, float).reshape(-1, 2)
    n, spark = len(x), returns.sparkSession
    if block > n:
        raise ValueError("the block is longer than the series")
    seen = float(sharpe(x[:, 0]) - sharpe(x[:, 1]))
    shared = spark.sparkContext.broadcast(x)

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, count = shared.value, -(-n // block)
        for batch in batches:
            for at in range(0, len(batch), 500):
                ids = batch["id"].to_numpy()[at : at + 500]
                starts = np.stack([np.random.default_rng([seed, int(i)]).integers(0, n - block + 1, count) for i in ids])
                rows = (starts[:, :, None] + np.arange(block)).reshape(len(ids), -1)[:, :n]
                yield pd.DataFrame({"d": sharpe(x[rows, 0]) - sharpe(x[rows, 1])})

    drawn = spark.range(0, iterations, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(resample, "d double")
    mean = drawn.agg(F.avg("d")).first()[0]
    hit = (F.abs(F.col("d") - mean) >= abs(seen) - 1e-12).cast("int")
    return drawn.agg(F.lit(seen).alias("difference"), F.percentile("d", F.lit(0.025)).alias("ci_lo"), F.percentile("d", F.lit(0.975)).alias("ci_hi"), ((F.sum(hit) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))
