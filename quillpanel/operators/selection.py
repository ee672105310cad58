"""Information coefficients of features and their selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions import cs


def guarded_corr(x: Column, y: Column) -> Column:
    """Correlation in a groupBy; NULL instead of an error where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def daily_ic(panel: DataFrame, features: list[str], target: str) -> DataFrame:
    """date and ic_<feature>: Spearman correlations, of ranks that each column takes over its own values. A date's rows go to one kernel, which ranks all columns; they must fit in a task."""

    def run(rows: pa.Table) -> pa.Table:
        *x, y = (cs.places(c.to_numpy(zero_copy_only=False).astype(float)) for c in rows.columns[1:])
        return pa.table([rows.column(0).slice(0, 1), *(pa.array([cs.correlation(v, y)], pa.float64()) for v in x)], names=["date", *(f"ic_{c}" for c in features)])

    narrow = panel.select("date", *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, target])))
    return narrow.groupBy("date").applyInArrow(run, ", ".join([f"date {dict(panel.dtypes)['date']}", *(f"`ic_{c}` double" for c in features)]))


def icir(ic: DataFrame, features: list[str], least: int = 2) -> DataFrame:
    """(feature, mean_ic, std_ic, n, ir): one row for each feature; ir is 0 below `least` dates or without spread."""
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"ic_{c}").alias("ic")) for c in features))).alias("s")
    long = ic.select(stack).select("s.*")
    out = long.groupBy("feature").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.count("ic").alias("n"))
    return out.withColumn("ir", F.when(F.col("n") < least, 0.0).otherwise(F.coalesce(F.try_divide("mean_ic", F.nullif("std_ic", F.lit(0.0))), F.lit(0.0))))


def select_by_icir(panel: DataFrame, features: list[str], target: str, threshold: float = 0.02) -> tuple[list[str], dict[str, float]]:
    """Features of |ir| over the threshold, in order, and all the irs."""
    return select_by_ics(daily_ic(panel, features, target), features, threshold)


def select_by_ics(ic: DataFrame, features: list[str], threshold: float = 0.02) -> tuple[list[str], dict[str, float]]:
    """select_by_icir() from the daily ICs (one number for each feature comes to the driver)."""
    found = {r["feature"]: r["ir"] for r in icir(ic, features).collect()}
    return [c for c in features if abs(found[c]) > threshold], found


def spearman_matrix(panel: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, rho) for each pair, over the rows that have all features. Ranks are global: a window over all rows would be one task, so they come from ranges of values.

    All features are ranked together, as rows (range, value), so the number of shuffles does not depend on theirs.
    """
    rows = panel.dropna(subset=features).select(*(cs.even(c).alias(c) for c in features))
    out = _global_ranks(rows, features).repartition("_row").groupBy("_row").agg(*(F.max(F.when(F.col("f") == i, F.col("k"))).alias(f"_k_{c}") for i, c in enumerate(features)))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    made = out.agg(*(guarded_corr(F.col(f"_k_{a}"), F.col(f"_k_{b}")).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return made.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")


def value_ranges(cuts: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Borders of ranges of values from quantiles, and which ranges hold one value only: a value that fills a range or more stands in the quantiles twice, and gets one of its own."""
    values, n = np.unique(np.array(cuts, float), return_counts=True)
    borders = np.unique(np.concatenate([values, np.nextafter(values[n > 1], np.inf)]))
    return borders, np.concatenate([[False], np.isin(borders[:-1], values[n > 1]), [False]]) if len(borders) else np.array([False])


def _global_ranks(rows: DataFrame, features: list[str]) -> DataFrame:
    """(_row, f, k): average rank of each row's value of each feature: the number of values in lower ranges and the rank within the range, which is one group of a kernel.
    There are about as many ranges of a feature as shuffle partitions. In a range of one value the count gives the rank; its rows pass in any group."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = [value_ranges(c) for c in rows.approxQuantile(features, [i / parts for i in range(1, parts)], 0.25 / parts)]
    width = max(len(alone) for _, alone in ranges)

    def placed(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, (borders, _) in enumerate(ranges):
            x = batch.column(i).to_numpy(zero_copy_only=False)
            yield i, x, np.searchsorted(borders, x, side="right")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(ranges), width), np.int64)
        for batch in batches:
            for i, _, at in placed(batch):
                found[i] += np.bincount(at, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(found.size)), pa.array(found.ravel())], names=["g", "n"])

    totals = np.zeros(len(ranges) * width, np.int64)
    for r in rows.mapInArrow(count, "g long, n long").where("n > 0").groupBy("g").agg(F.sum("n").alias("n")).collect():
        totals[r["g"]] = r["n"]
    totals = totals.reshape(-1, width)
    before = np.cumsum(totals, axis=1) - totals

    def melt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(len(ranges))
            for i, x, at in placed(batch):
                known = ranges[i][1][at]
                v = np.where(known, before[i, at] + (totals[i, at] + 1) / 2, x)
                group = np.where(known, -1 - row.to_numpy() % width, i * width + at)
                yield pa.RecordBatch.from_arrays([row, pa.array(np.full(len(x), i, np.int32)), pa.array(group), pa.array(v)], names=["_row", "f", "g", "v"])

    def rank(group: pa.Table) -> pa.Table:
        g, v = group.column("g")[0].as_py(), group.column("v").to_numpy()
        if g >= 0:
            _, at, n = np.unique(v, return_inverse=True, return_counts=True)
            v = before[g // width, g % width] + (np.cumsum(n) - (n - 1) / 2)[at]
        return pa.table([group.column("_row"), group.column("f"), pa.array(v, pa.float64())], names=["_row", "f", "k"])

    melted = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(melt, "_row long, f int, g long, v double")
    return melted.groupBy("g").applyInArrow(rank, "_row long, f int, k double")


def prune(ir: dict[str, float], rho: dict[tuple[str, str], float], groups: list[list[str]], threshold: float = 0.75) -> list[str]:
    """Greedy, in order within each group: of a pair at the threshold the lower |ir| goes, the later on a tie. A feature that has gone still strikes later ones."""
    kept: list[str] = []
    for group in groups:
        gone: set[str] = set()
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if b not in gone and abs(rho.get((a, b), rho.get((b, a), 0.0)) or 0.0) >= threshold:
                    gone.add(b if abs(ir.get(a, 0.0)) >= abs(ir.get(b, 0.0)) else a)
        kept += [c for c in group if c not in gone]
    return kept


def correlations(panel: DataFrame, features: list[str]) -> dict[tuple[str, str], float]:
    return {(r["a"], r["b"]): r["rho"] for r in spearman_matrix(panel, features).collect()}


def permuted(panel: DataFrame, features: list[str], seed: int = 42) -> DataFrame:
    """panel once as it is (feature NULL) and once for each feature, with that feature's values shuffled within each date.

    The shuffle orders a date's rows by a hash of (symbol, feature, seed) and hands the k-th row of that order the value of the k-th row by symbol. All features are shuffled in
    one aggregation by date; a date's cross-section fits in a task.
    """
    others = [c for c in panel.columns if c not in ("date", *features)]
    row = F.struct("symbol", *(F.col(c).alias(f"v{i}") for i, c in enumerate(features)), *(F.col(c).alias(f"o{i}") for i, c in enumerate(others)))
    shuffled = [F.array_sort(F.collect_list(F.struct(shuffle_key("symbol", i, seed).alias("h"), "symbol", row.alias("r")))).alias(f"h{i}") for i in range(len(features))]
    day = panel.groupBy("date").agg(F.array_sort(F.collect_list(row)).alias("rows"), *shuffled)

    def version(i: int | None) -> Column:
        """All rows of the date, with feature i taken from the row by symbol that stands in the same place."""

        def made(own: Column, given: Column) -> Column:
            values = ((given if j == i else own)[f"v{j}"].alias(f"v{j}") for j in range(len(features)))
            return F.struct(F.lit(None if i is None else features[i]).cast("string").alias("feature"), *(own[f"o{j}"].alias(f"o{j}") for j in range(len(others))), *values)

        if i is None:
            return F.transform("rows", lambda r: made(r, r))
        return F.zip_with(f"h{i}", "rows", lambda h, r: made(h["r"], r))

    every = day.select("date", F.explode(F.concat(*(version(i) for i in [None, *range(len(features))]))).alias("x"))
    return every.select("date", *(F.col(f"x.o{j}").alias(c) for j, c in enumerate(others)), *(F.col(f"x.v{j}").alias(c) for j, c in enumerate(features)), "x.feature")


def shuffle_key(symbol: str, feature: int, seed: int) -> Column:
    """A whole number that any engine can repeat: a multiplicative mix of the symbol's number, the feature's and the seed."""
    h = (F.col(symbol).cast("long") * 1000003 + feature * 7919 + seed) % 2147483647
    for _ in range(3):
        h = (h * 48271 + 11) % 2147483647
    return h


def importances(panel: DataFrame, features: list[str], target: str, score: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """(feature, mean_ic, importance): how much a model's mean daily rank correlation with the target falls when the feature is shuffled. score adds pred_score to a table."""
    rows = score(permuted(panel, features, seed)).select("date", F.coalesce("feature", F.lit("")).alias("feature"), F.round("pred_score", 10).alias("s"), F.round(target, 10).alias("y"))
    of = Window.partitionBy("date", "feature")
    ranked = rows.select("date", "feature", cs.rank("s", day=of).alias("a"), cs.rank("y", day=of).alias("b"))
    means = ranked.groupBy("feature", "date").agg(guarded_corr(F.col("a"), F.col("b")).alias("ic")).groupBy("feature").agg(F.avg("ic").alias("mean_ic"))
    base = means.where("feature = ''").select(F.col("mean_ic").alias("_base"))
    return means.where("feature <> ''").join(F.broadcast(base)).select("feature", "mean_ic", (F.col("_base") - F.col("mean_ic")).alias("importance"))
