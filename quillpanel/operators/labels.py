"""Labels within a date, market regime and breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpanel.functions import cs, ewm, ts


def by_date():
    """Daily series are collapsed to a row for each date before any window without a key."""
    return Window.orderBy("date")


def magnitude(panel: DataFrame, source: str = "risk_adj_ret", winsor: float = 0.0) -> DataFrame:
    """target_magnitude: 0 to 100 between the date's least and largest value, both clipped at the winsor share; NULL without a range."""
    x = F.col(source)
    ends = (F.percentile(x, F.lit(winsor)), F.percentile(x, F.lit(1 - winsor))) if winsor else (F.min(x), F.max(x))
    day = panel.groupBy("date").agg(ends[0].alias("_lo"), ends[1].alias("_hi"))
    clipped = F.least(F.greatest(x, F.col("_lo")), F.col("_hi"))
    scaled = F.when(x.isNotNull() & (F.col("_hi") > F.col("_lo")), (clipped - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)
    return panel.join(F.broadcast(day), "date", "left").withColumn("target_magnitude", scaled).drop("_lo", "_hi")


def adaptive_bucket(panel: DataFrame, source: str = "risk_adj_ret", per: int = 20) -> DataFrame:
    """target_bucket: as many buckets as one for `per` values (half to even, two at least); NULL on days with fewer values than buckets."""
    n = F.count(source).over(cs.per_date())
    q = F.greatest(F.bround(n / per).cast("int"), F.lit(2))
    return panel.withColumn("target_bucket", F.when(n >= q, cs.bucket(F.col("symbol"), F.round(source, 10), q)))


def quintile(panel: DataFrame, source: str, name: str = "target_quintile", q: int = 5) -> DataFrame:
    """NULL on days with fewer than q values."""
    return panel.withColumn(name, F.when(F.count(source).over(cs.per_date()) >= q, cs.bucket(F.col("symbol"), F.round(source, 10), q)))


def with_qid(panel: DataFrame) -> DataFrame:
    """qid: number of the date, from 0, by way of the small table of dates."""
    days = panel.select("date").distinct().withColumn("qid", (F.row_number().over(by_date()) - 1).cast("int"))
    return panel.join(F.broadcast(days), "date")


def ranked(panel: DataFrame, columns: list[str], mask: Column | None = None) -> DataFrame:
    return panel.withColumns({f"csr_{c}": cs.rank(F.round(c, 10), mask) for c in columns})


def _day_rank(x: str, n: int) -> Column:
    values = F.collect_list(F.col(x)).over(by_date().rowsBetween(-(n - 1), 0))
    v = F.col(x)
    share = (F.size(F.filter(values, lambda y: y < v)) + (F.size(F.filter(values, lambda y: y == v)) + 1) / 2) / F.size(values)
    return F.when((F.size(values) >= n) & v.isNotNull(), share)


def regime_days(panel: DataFrame, n: int = 21, smooth: int = 63, history: int = 252) -> DataFrame:
    """Per date: smoothed median deviation of the liquid symbols' monthly returns, its rank in its history, and the quarter Q1 (calm) to Q4."""
    mask = F.col("is_liquid") if "is_liquid" in panel.columns else F.lit(True)
    r = panel.withColumn("_m", F.try_divide("close", ts.delay("close", n)) - 1).withColumn("_m", ts.delay("_m", 1))
    r = r.select("date", F.when(mask, F.col("_m")).alias("m"))
    middle = r.groupBy("date").agg(F.median("m").alias("mid"))
    return regime_of(r.join(middle, "date").groupBy("date").agg(F.median(F.abs(F.col("m") - F.col("mid"))).alias("mad")), smooth, history)


def regime_of(day: DataFrame, smooth: int = 63, history: int = 252) -> DataFrame:
    """regime_days() from each date's median deviation, mad."""
    w = by_date().rowsBetween(-(smooth - 1), 0)
    day = day.withColumn("regime_mad", F.round(F.when(F.count("mad").over(w) >= smooth // 2, F.avg("mad").over(w)), 10))
    day = day.withColumn("regime_rank", _day_rank("regime_mad", history))
    k = F.col("regime_rank")
    return day.withColumn("regime_bucket", F.when(k <= 0.25, "Q1").when(k <= 0.5, "Q2").when(k <= 0.75, "Q3").when(k <= 1, "Q4")).select("date", "regime_mad", "regime_rank", "regime_bucket")


def _day_ema(days: DataFrame, columns: dict[str, tuple[str, float]]) -> DataFrame:
    return ewm.averages(days.withColumn("_one", F.lit(1)), columns, "_one").drop("_one")


def market_days(panel: DataFrame) -> DataFrame:
    """Per date: EMAs of the liquid symbols' mean log returns over three months (63) and one (21)."""
    mask = F.col("is_liquid") if "is_liquid" in panel.columns else F.lit(True)
    day = panel.groupBy("date").agg(F.avg(F.when(mask, F.col("log_ret_3m"))).alias("a3"), F.avg(F.when(mask, F.col("log_ret_1m"))).alias("a1"))
    return market_of(day)


def market_of(day: DataFrame) -> DataFrame:
    """market_days() from each date's means, a3 and a1."""
    return _day_ema(day, {"market3m_ema63": ("a3", ewm.span(63)), "market1m_ema21": ("a1", ewm.span(21))}).select("date", "market3m_ema63", "market1m_ema21")


def breadth_days(panel: DataFrame, source: str = "log_ret_1m", history: int = 252) -> DataFrame:
    """Per date: EMA 21 of the share of rising symbols, and whether it is below the lower quarter of its history to the day before."""
    mask = F.col("is_liquid") if "is_liquid" in panel.columns else F.lit(True)
    day = panel.groupBy("date").agg(F.avg(F.when(mask & F.col(source).isNotNull(), (F.col(source) > 0).cast("double"))).alias("up"))
    return breadth_of(day, history)


def breadth_of(day: DataFrame, history: int = 252) -> DataFrame:
    """breadth_days() from each date's share of rising symbols, up."""
    day = _day_ema(day, {"breadth_ema21": ("up", ewm.span(21))})
    day = day.withColumn("_b", F.lag("breadth_ema21").over(by_date()))
    w = by_date().rowsBetween(-(history - 1), 0)
    low = F.when(F.count("_b").over(w) >= history // 2, F.percentile("_b", F.lit(0.25)).over(w))
    return day.withColumn("narrow_breadth", F.coalesce(F.col("breadth_ema21") < low, F.lit(False))).select("date", "breadth_ema21", "narrow_breadth")


def gate(days: DataFrame) -> DataFrame:
    """filter_active on the latest date: a calm regime while the monthly market average is below the quarterly one."""
    last = days.orderBy(F.desc("date")).limit(1)
    return last.select("date", F.coalesce((F.col("regime_bucket") == "Q1") & (F.col("market1m_ema21") - F.col("market3m_ema63") < 0), F.lit(False)).alias("filter_active"))
