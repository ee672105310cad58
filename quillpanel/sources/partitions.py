"""A stored panel that takes upserts by partition: rows in folders by year and symbol bucket, beside them a small table of marks.

A mark says where a symbol's rows of a year begin and end and what its last close was. From marks an upsert learns, without reading other years, which close comes
before a partition's first row, and which later partition begins with a row whose flags hang on a changed close. Only partitions that can change are read and written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillpanel.sources.market import flag, keep_last, saved


def bucket_of(symbol: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(symbol).cast("string")), F.lit(buckets)).cast("int")


def _placed(panel: DataFrame, buckets: int) -> DataFrame:
    return panel.withColumns({"year": F.year("date"), "bucket": bucket_of("symbol", buckets)})


def _write(table: DataFrame, path: str, mode: str) -> None:
    """One task for each (year, bucket), so `buckets` sets the size of files; overwriting replaces the partitions at hand only."""
    table.repartition("year", "bucket").sortWithinPartitions("year", "bucket", "symbol").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year", "bucket").parquet(path)


def _marks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol", "year", "bucket").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_close"))


def create(panel: DataFrame, path: str, buckets: int = 16, move: float = 0.15) -> None:
    """Stores a panel (with close_raw) and its flags; whatever lies at the path is replaced."""
    rows = saved(_placed(flag(panel, move), buckets), "panel-rows")
    for table, name in ((rows, "rows"), (_marks(rows), "marks")):
        table.repartition("year", "bucket").sortWithinPartitions("year", "bucket", "symbol").write.mode("overwrite").partitionBy("year", "bucket").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("year", "bucket")


def high_water(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, last_date) from the marks: what an incremental refresh asks for, without a scan of rows."""
    return spark.read.parquet(f"{path}/marks").groupBy("symbol").agg(F.max("last_date").alias("last_date"))


def _within(partitions: list[tuple[int, int]]) -> Column:
    """A filter on partition columns, which prunes folders; as many terms as years."""
    test = F.lit(False)
    for year in sorted({y for y, _ in partitions}):
        test = test | ((F.col("year") == year) & F.col("bucket").isin([b for y, b in partitions if y == year]))
    return test


def prepared(new: DataFrame, since: str = "2016-01-01", order: Column | None = None) -> DataFrame:
    """New rows with close_raw (close stands in for a missing column), one for each key: the last by `order`, by default the largest by all columns; none before `since`."""
    new = new if "close_raw" in new.columns else new.withColumn("close_raw", F.col("close"))
    return keep_last(new, F.struct(*sorted(new.columns)) if order is None else order).drop("f_dup").where(F.col("date") >= since)


def upsert(spark: SparkSession, path: str, new: DataFrame, buckets: int = 16, since: str = "2016-01-01", move: float = 0.15, order: Column | None = None) -> list[tuple[int, int]]:
    """Merges new rows into a stored panel and returns the (year, bucket) partitions that were written.

    New rows, as prepared() gives them, win; the first close_raw ever seen for a key stays; flags are computed again where they can change. A repeated batch gives the same panel.
    """
    new = saved(_placed(prepared(new, since, order), buckets), "panel-new")
    touched = {(r["year"], r["bucket"]) for r in new.select("year", "bucket").distinct().collect()}
    if not touched:
        return []
    rows, marks = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/marks")
    marks = saved(marks.where(F.col("bucket").isin(sorted({b for _, b in touched}))), "panel-marks")
    later = new.select("symbol", F.col("year").alias("_y"), "bucket").distinct().join(marks.select("symbol", "year"), "symbol").where("year > _y").groupBy("symbol", "_y", "bucket").agg(F.min("year").alias("year"))
    part = sorted(touched | {(r["year"], r["bucket"]) for r in later.select("year", "bucket").distinct().collect()})
    old = rows.where(_within(part)).select(*[c for c in new.columns if c in rows.columns])
    fresh = new.join(old.select("symbol", "date", F.col("close_raw").alias("_raw")), ["symbol", "date"], "left").withColumn("close_raw", F.coalesce("_raw", "close_raw")).drop("_raw")
    both = old.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("_p")))).where("_n = 1").drop("_n", "_p")
    before = marks.where(~_within(part)).select("symbol", F.col("last_date").alias("date"), F.col("last_close").alias("close"), "year", "bucket", F.lit(True).alias("_mark"))
    flagged = flag(both.withColumn("_mark", F.lit(False)).unionByName(before, allowMissingColumns=True), move).where("not _mark").drop("_mark")
    flagged = saved(flagged, "panel-merged")
    _write(flagged, f"{path}/rows", "overwrite")
    _write(_marks(flagged), f"{path}/marks", "overwrite")
    return part
