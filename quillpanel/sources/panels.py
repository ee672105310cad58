"""Panels keyed by (symbol, date), derived from the lineitem table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def clean(panel: DataFrame) -> DataFrame:
    """Doubles without NaN (NULL instead), dates without time."""
    numbers = [c for c, t in panel.dtypes if t in ("double", "float")]
    return panel.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in numbers} | {"date": F.to_date("date")})


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trade_panel(spark: SparkSession, sf_dir: str, symbol: str = "l_suppkey") -> DataFrame:
    """Open and close of the day's first and last line by (order, line, price), highest and lowest price, quantity."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("date"), F.struct("l_orderkey", "l_linenumber", price.alias("p")).alias("k"), price.alias("p"), "l_quantity")
    day = lines.groupBy("symbol", "date").agg(F.min("k").alias("a"), F.max("p").alias("high"), F.min("p").alias("low"), F.max("k").alias("z"), F.sum("l_quantity").alias("volume"))
    return day.select("symbol", "date", F.col("a.p").alias("open"), "high", "low", F.col("z.p").alias("close"), "volume")


def walk_panel(spark: SparkSession, sf_dir: str, weekly: bool = False, parts: int | None = None) -> DataFrame:
    """A random walk for each supplier: the close moves with the day's (or week's) mean discount, so bars are never flagged.

    parts: lines go to their symbol in one exchange, for the bars and the walk, into so many tasks; by default tasks are joined to a size in bytes, so there are few over a small table.
    """
    date = F.to_date(F.date_trunc("week", "l_shipdate")) if weekly else F.to_date("l_shipdate")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("symbol"), date.alias("date"), "l_quantity", "l_discount")
    lines = lines.repartition(parts, "symbol") if parts else lines
    day = lines.groupBy("symbol", "date").agg(F.sum("l_quantity").alias("volume"), F.avg("l_discount").alias("d"))
    w = Window.partitionBy("symbol").orderBy("date")
    day = day.withColumn("close", F.round(100 * F.exp(F.sum((F.col("d") - 0.05) / 5).over(w.rowsBetween(Window.unboundedPreceding, 0))), 6))
    day = day.withColumn("open", F.coalesce(F.lag("close").over(w), "close"))
    return day.select("symbol", "date", "open", F.round(1.005 * F.greatest("open", "close") + 1.7e-9, 6).alias("high"), F.round(0.995 * F.least("open", "close") + 1.7e-9, 6).alias("low"), "close", "volume")
