"""Scans, upserts, quality flags and reconciliation of market data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = ("open", "high", "low", "close", "volume")


def scan(spark: SparkSession, path: str, symbols: list[str] | None = None, first: str | None = None, last: str | None = None, excluded: list[str] | None = None) -> DataFrame:
    """A stored panel with its filters on the scan: universe, inclusive date range, excluded dates."""
    panel = spark.read.parquet(path)
    for bound, test in ((symbols, lambda: F.col("symbol").isin(symbols)), (first, lambda: F.col("date") >= first), (last, lambda: F.col("date") <= last), (excluded, lambda: ~F.col("date").isin(excluded))):
        panel = panel.where(test()) if bound else panel
    return panel


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all machines see; where none is set, on one machine, in a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillpanel-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(table: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read again."""
    path = shared_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


class Scratch:
    """Tables that one fit writes to the shared folder, as saved() does, and takes away when it ends or no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.leave(0)

    def saved(self, table: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """by: a column whose values get a folder each, so that a filter on it reads no more than its own."""
        self.paths.append(shared_path(self.spark, name))
        (table.write.partitionBy(by) if by else table.write).parquet(self.paths[-1])
        return self.spark.read.schema(table.schema).parquet(self.paths[-1])

    def leave(self, last: int) -> None:
        """Deletes all tables but the last ones."""
        gone, self.paths = (self.paths[: len(self.paths) - last], self.paths[len(self.paths) - last :])
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def store(panel: DataFrame, path: str, mode: str = "overwrite", files: int = 8) -> None:
    """Parquet in folders by year, so that date filters prune them; a year's symbols are dealt over `files` tasks and files."""
    part = F.pmod(F.xxhash64(F.col("symbol").cast("string")), F.lit(files))
    panel.withColumn("year", F.year("date")).repartition("year", part).sortWithinPartitions("year", "symbol", "date").write.mode(mode).partitionBy("year").parquet(path)


def store_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").csv(path, header=True)


def last_trading_day(now: datetime) -> date:
    """Today after 14:45 on a weekday, else the business day before (exchange time)."""
    day = now.date() if now.time() >= time(14, 45) else now.date() - timedelta(days=1)
    while day.weekday() > 4:
        day -= timedelta(days=1)
    return day


def flag(panel: DataFrame, move: float = 0.15) -> DataFrame:
    """f_nan, f_bad_ohlc, f_zero_vol, f_big_move, f_dup, f_any. A comparison with NULL is false, a NULL volume counts as none; f_dup is carried if there."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))
    o, h, lo, c = (F.col(x) for x in BARS[:4])
    false = lambda x: F.coalesce(x, F.lit(False))
    any_of = lambda xs: xs[0] if len(xs) == 1 else xs[0] | any_of(xs[1:])
    flags = {
        "f_nan": any_of([F.col(x).isNull() for x in BARS]),
        "f_bad_ohlc": any_of([false(x) for x in (h < lo, h < o, h < c, lo > o, lo > c, o <= 0, h <= 0, lo <= 0, c <= 0)]),
        "f_zero_vol": ~false(F.col("volume") > 0),
        "f_big_move": false(F.abs(F.try_divide("close", before) - 1) > move),
        "f_dup": false(F.col("f_dup")) if "f_dup" in panel.columns else F.lit(False),
    }
    return panel.withColumns(flags).withColumn("f_any", any_of([F.col(f) for f in flags]))


def keep_last(rows: DataFrame, order: Column) -> DataFrame:
    """One row for each (symbol, date), the last by order; f_dup tells that there were more."""
    key = Window.partitionBy("symbol", "date")
    ranked = rows.withColumns({"f_dup": F.count(F.lit(1)).over(key) > 1, "_n": F.row_number().over(key.orderBy(order.desc()))})
    return ranked.where("_n = 1").drop("_n")


def merge(existing: DataFrame, new: DataFrame, since: str = "2016-01-01") -> DataFrame:
    """Upsert: new rows win; the first close_raw ever seen for a key stays. Both need close_raw. Flags are computed again."""
    first = existing.select("symbol", "date", F.col("close_raw").alias("_raw"))
    fresh = new.join(first, ["symbol", "date"], "left").withColumn("close_raw", F.coalesce("_raw", "close_raw")).drop("_raw")
    both = existing.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("_p"))))
    return flag(ranked.where((F.col("_n") == 1) & (F.col("date") >= since)).drop("_n", "_p"))


def stale_symbols(universe: DataFrame, panel: DataFrame, last: Column) -> DataFrame:
    """Symbols of the universe whose rows do not reach the last trading day, or that have none."""
    current = panel.groupBy("symbol").agg(F.max("date").alias("_last")).where(F.col("_last") >= last)
    return universe.join(current, "symbol", "left_anti")


def refresh(panel: DataFrame, universe: DataFrame, fetch: Callable[[list[str]], DataFrame | None], last: Column, batch: int = 50) -> DataFrame:
    """Fetches stale symbols batch by batch (a universe is a few hundred names) and merges what comes."""
    stale = [r[0] for r in stale_symbols(universe, panel, last).orderBy("symbol").collect()]
    chunks = [c for i in range(0, len(stale), batch) if (c := fetch(stale[i : i + batch])) is not None]
    for c in chunks[1:]:
        chunks[0] = chunks[0].unionByName(c, allowMissingColumns=True)
    return merge(panel, chunks[0]) if chunks else panel


def reconcile(a: DataFrame, b: DataFrame, tolerance: float = 0.005, least: int = 100, most: float = 0.10) -> DataFrame:
    """On the last common date with volume on both sides: rows, share of |ln ratio of closes| over the tolerance, alarm."""
    both = a.select("symbol", "date", F.col("close").alias("close_a"), F.col("volume").alias("va")).join(b.select("symbol", "date", F.col("close").alias("close_b"), F.col("volume").alias("vb")), ["symbol", "date"])
    both = both.where("va > 0 and vb > 0")
    day = both.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg((F.abs(F.ln(F.try_divide("close_b", "close_a"))) > tolerance).cast("double")).alias("share"))
    return day.orderBy(F.desc("date")).limit(1).withColumn("alarm", (F.col("n") < least) | (F.col("share") > most))


def trading_day(now: str | Column) -> Column:
    """last_trading_day() of a column of timestamps."""
    now = F.col(now) if isinstance(now, str) else now
    done = F.hour(now) * 60 + F.minute(now) >= 14 * 60 + 45
    day = F.when(done, F.to_date(now)).otherwise(F.date_sub(F.to_date(now), 1))
    return F.date_sub(day, F.when(F.weekday(day) > 4, F.weekday(day) - 4).otherwise(0))


def fingerprint(table: DataFrame) -> DataFrame:
    """Rows and an order-free sum of row hashes: equal for equal contents."""
    return table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")).alias("hash"))


def clean_symbols(names: DataFrame) -> DataFrame:
    return names.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()


def date_ranges(panel: DataFrame) -> DataFrame:
    return panel.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def taint(panel: DataFrame, forward: bool = False, back: int = 21, ahead: int = 20) -> DataFrame:
    """tainted: a flagged bar in the own and `back` earlier rows, or (forward) in the own and `ahead` later rows."""
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, ahead) if forward else Window.partitionBy("symbol").orderBy("date").rowsBetween(-back, 0)
    return panel.withColumn("tainted", F.max(F.col("f_any").cast("int")).over(w) == 1)
