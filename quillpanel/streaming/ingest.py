"""Streams: upsert of arriving bars, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillpanel.sources import partitions


def bars(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, buckets: int = 16, since: str = "2016-01-01") -> StreamingQuery:
    """Each micro-batch goes into the panel stored at the path by its partitions; the first one makes it. A batch that is repeated after a failure changes nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if number == 0:
            partitions.create(partitions.prepared(batch, since), path, buckets)
        else:
            partitions.upsert(spark, path, batch, buckets, since)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and value by tumbling window and type; on a stream, rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
