"""Ranking metrics by date, performance of a value series, and the tables behind plots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions import cs
from quillpanel.operators.labels import by_date
from quillpanel.operators.selection import guarded_corr
from quillpanel.sources.market import saved

def _place(score: str):
    """Place from 1 by descending score, ties by symbol."""
    return F.row_number().over(cs.per_date().orderBy(F.col(score).desc_nulls_last(), "symbol"))


def top_k(table: DataFrame, score: str, k: int) -> DataFrame:
    return table.withColumn("place", _place(score)).where(F.col("place") <= k)


def topk_excess(table: DataFrame, score: str, ret: str, k: int) -> DataFrame:
    """Per date with k rows or more: mean return of the k best less that of all."""
    ranked = table.where(F.col(ret).isNotNull()).withColumn("_p", _place(score))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("_p") <= k, F.col(ret))) - F.avg(ret)).alias("excess")).where(F.col("n") >= k)


def precision_at_k(table: DataFrame, score: str, label: str, k: int) -> DataFrame:
    ranked = table.select("date", _place(score).alias("p"), _place(label).alias("q"))
    return ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), (F.sum(((F.col("p") <= k) & (F.col("q") <= k)).cast("int")) / k).alias("precision")).where(F.col("n") >= k)


def ndcg(table: DataFrame, score: str, label: str, k: int | None = None) -> DataFrame:
    """Per date with over one row; the gain is the label itself. Rows of equal score share their places' mean discount."""
    discount = lambda p: (F.when(p <= k, 1 / F.log2(p + 1)).otherwise(0.0) if k else 1 / F.log2(p + 1))
    rows = table.select("date", "symbol", F.round(score, 10).alias("s"), F.col(label).alias("g"))
    rows = rows.withColumns({"_d": discount(F.row_number().over(cs.per_date().orderBy(F.desc("s"), "symbol"))), "_i": discount(F.row_number().over(cs.per_date().orderBy(F.desc("g"), "symbol")))})
    tied = rows.groupBy("date", "s").agg((F.sum("g") * F.avg("_d")).alias("dcg"), F.sum(F.col("g") * F.col("_i")).alias("ideal"), F.count(F.lit(1)).alias("n"))
    return tied.groupBy("date").agg(F.try_divide(F.sum("dcg"), F.sum("ideal")).alias("ndcg"), F.sum("n").alias("n")).where("n > 1").select("date", "ndcg")


def model_ic(table: DataFrame, score: str, ret: str) -> DataFrame:
    """One row: mean, spread and ratio (0 without spread) of the daily Spearman correlations."""
    day = table.select("date", cs.rank(F.round(score, 10)).alias("a"), cs.rank(F.round(ret, 10)).alias("b")).groupBy("date").agg(guarded_corr(F.col("a"), F.col("b")).alias("ic"))
    out = day.agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"))
    return out.withColumn("ir", F.coalesce(F.try_divide("mean_ic", F.nullif("std_ic", F.lit(0.0))), F.lit(0.0)))


def win_rate(table: DataFrame, score: str, ret: str, top: float = 0.2) -> DataFrame:
    """Share of rising rows in the top share of each date, in the market, and their difference; a missing return does not rise."""
    rows = table.select(F.coalesce(F.col(ret) > 0, F.lit(False)).cast("double").alias("up"), cs.rank(-F.round(score, 10)).alias("k"))
    out = rows.agg(F.avg(F.when(F.col("k") <= top, F.col("up"))).alias("top_rate"), F.avg("up").alias("market_rate"))
    return out.withColumn("lift", F.col("top_rate") - F.col("market_rate"))


def return_by_quintile(table: DataFrame, score: str, ret: str, q: int = 5) -> DataFrame:
    rows = table.withColumn("quintile", cs.bucket(F.col("symbol"), F.round(score, 10), q))
    return rows.groupBy("quintile").agg(F.avg(ret).alias("mean_ret"), F.count(ret).alias("n"))


def monthly_ic(table: DataFrame, score: str, ret: str) -> DataFrame:
    month = Window.partitionBy("month")
    rows = table.withColumn("month", F.trunc("date", "MM"))
    rows = rows.select("month", cs.rank(F.round(score, 10), day=month).alias("a"), cs.rank(F.round(ret, 10), day=month).alias("b"))
    return rows.groupBy("month").agg(guarded_corr(F.col("a"), F.col("b")).alias("ic"))


def rolling_ir(ic: DataFrame, n: int, order: str = "month") -> DataFrame:
    w = Window.orderBy(order).rowsBetween(-(n - 1), 0)
    return ic.withColumn("ir", F.when(F.count("ic").over(w) >= n, F.try_divide(F.avg("ic").over(w), F.nullif(F.stddev_samp("ic").over(w), F.lit(0.0)))))


def performance(nav: DataFrame, initial: float | None = None, rate: float = 0.045) -> DataFrame:
    """One row from (date, total_value): total return, CAGR, Sharpe, Sortino, largest drawdown, Calmar. A value series has a row for each day, so one sorted run is fine."""
    w = by_date()
    rows = nav.select("date", "total_value", (F.try_divide("total_value", F.lag("total_value").over(w)) - 1 - rate / 252).alias("x"), F.max("total_value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("peak"))
    a = rows.agg(
        F.min_by("total_value", "date").alias("v0"), F.max_by("total_value", "date").alias("v1"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.avg("x").alias("m"),
        F.stddev_samp("x").alias("s"), F.stddev_samp(F.least("x", F.lit(0.0)) + F.col("x") * 0).alias("d"), F.min((F.col("total_value") - F.col("peak")) / F.col("peak")).alias("max_drawdown"),
    )
    start = F.lit(initial) if initial else F.col("v0")
    a = a.withColumns({"total_return": F.col("v1") / start - 1, "cagr": F.pow(F.col("v1") / start, 1 / F.greatest(F.col("days") / 365.25, F.lit(1 / 12))) - 1})
    per = lambda s: F.coalesce(F.try_divide(F.col("m"), F.nullif(F.col(s), F.lit(0.0))) * (252**0.5), F.lit(0.0))
    calmar = F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0)
    return a.select("total_return", "cagr", per("s").alias("sharpe"), per("d").alias("sortino"), "max_drawdown", calmar.alias("calmar"))


def regime_islands(days: DataFrame, column: str) -> DataFrame:
    """Runs of equal values: first and last date, and length."""
    marked = days.withColumn("_new", (~F.col(column).eqNullSafe(F.lag(column).over(by_date()))).cast("int"))
    runs = marked.withColumn("island", F.sum("_new").over(by_date()))
    return runs.groupBy("island", column).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def outlier_report(values: DataFrame, x: str, share: float = 0.01) -> DataFrame:
    """One row: n, mean, std, min, p1, p99, max and the share of variance that the most extreme values hold."""
    v = saved(values.where(F.col(x).isNotNull()).select(x), "outlier-values")  # a dozen passes read one column, and do not make it anew
    stats = v.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    n, mean = stats.select("n", "mean").first()
    p1, p99 = (percentile(v, x, q, n) for q in (0.01, 0.99))
    stats = stats.select("n", "mean", "std", "min", F.lit(p1).cast("double").alias("p1"), F.lit(p99).cast("double").alias("p99"), "max")
    dev = v.select(F.pow(F.col(x) - F.lit(mean), 2).alias("d"))
    k = max(1, int(n * share))
    least = nth_largest(dev, "d", k)
    above = F.coalesce(F.sum(F.when(F.col("d") > least, F.col("d"))), F.lit(0.0)) + (F.lit(k) - F.count(F.when(F.col("d") > least, 1))) * F.lit(least)  # rows that tie with the last one count as often as they fit
    return stats.crossJoin(F.broadcast(dev.agg(F.try_divide(above, F.sum("d")).alias("top_variance_share"))))


def nth_largest(values: DataFrame, x: str, n: int, buckets: int = 4096, few: int = 10_000) -> float | None:
    """The n-th largest value: bucket counts narrow the range until few values are left in it, so no task ever sorts more than those."""
    lo, hi, total = values.agg(F.min(x), F.max(x), F.count(x)).first()
    while total > few and lo < hi:
        width = (hi - lo) / buckets
        place = F.least(F.floor((F.col(x) - lo) / width), F.lit(buckets - 1)) if width > 0 else F.lit(0)
        inside = values.where(F.col(x).between(lo, hi)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["b"]):
            if n <= r["n"]:
                lo, hi, narrowed = r["lo"], r["hi"], r["n"] < total
                total = r["n"]
                break
            n -= r["n"]
        if not narrowed:
            break  # as narrow as doubles are
    if total == 0 or lo == hi:
        return lo
    return values.where(F.col(x).between(lo, hi)).orderBy(F.desc(x)).limit(n).agg(F.min(x)).first()[0]


def percentile(values: DataFrame, x: str, share: float, n: int) -> float | None:
    """Between the two values of n that the share falls between, in proportion."""
    if not n:
        return None
    at = share * (n - 1)
    low, up = (nth_largest(values, x, n - k) for k in (math.floor(at), math.ceil(at)))
    return low + (up - low) * (at - math.floor(at))


def model_ranking(table: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """(model, average_rank) over the metrics; True where more is better. Metrics are rounded first: the last bit of an average depends on the order of its rows. A table of models is tiny."""
    one = Window.partitionBy(F.lit(0))
    ranks = [cs.rank(F.round(m, 10) * (-1 if best else 1), day=one) * F.count(m).over(one) for m, best in metrics.items()]
    return table.select("model", (sum(ranks[1:], ranks[0]) / len(ranks)).alias("average_rank"))
