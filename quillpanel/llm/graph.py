"""Connected components of an edge table by alternating stars; nothing but the count of changed rows reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import save


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b): label is the smallest node that it reaches. Loops and repeated edges are harmless.

    A large star hangs a node's larger neighbours on its smallest one, a small star its smaller ones; a hub's edges are summed map-side, and joins on it may be split.
    """
    now = save(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = save(_distinct(small), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
