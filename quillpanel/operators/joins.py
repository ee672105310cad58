"""As-of lookups and the joins of panels with small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillpanel.functions import cs
from quillpanel.sources.panels import shuffle_parts


def asof(left: DataFrame, right: DataFrame, value: str, strict: bool = False, forward: bool = False) -> DataFrame:
    """left with `value` of right's nearest row at or before (after, if forward; never at, if strict) its date, by symbol; NULL values are skipped.

    Both sides are put into one sorted run for each symbol, so no pair of rows is ever formed.
    """
    order = 1 if strict != forward else 0  # whether right's rows of a date come after left's
    names = left.columns
    rows = left.withColumns({"_side": F.lit(1 - order), "_v": F.lit(None).cast(dict(right.dtypes)[value]), "_mine": F.lit(True)})
    marks = right.where(F.col(value).isNotNull()).select("symbol", "date", F.lit(order).alias("_side"), F.col(value).alias("_v"), F.lit(False).alias("_mine"))
    w = Window.partitionBy("symbol").orderBy("date", "_side")
    found = F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if forward else F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.unionByName(marks, allowMissingColumns=True).withColumn(value if value not in names else f"asof_{value}", found).where("_mine").drop("_side", "_v", "_mine")


def in_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    return panel.join(universe.select("symbol"), "symbol", "left_semi")


def gone(held: DataFrame, today: DataFrame) -> DataFrame:
    """Held symbols that have no row today."""
    return held.join(today.select("symbol"), "symbol", "left_anti")


def dates_match(raw: DataFrame, predictions: DataFrame) -> DataFrame:
    """Dates that only one side has: an empty result lets a simulation start."""
    a, b = raw.select("date").distinct(), predictions.select("date").distinct()
    return a.join(b, "date", "left_anti").withColumn("only", F.lit("raw")).union(b.join(a, "date", "left_anti").withColumn("only", F.lit("predictions")))


def broadcast_days(panel: DataFrame, days: DataFrame, limit: int = 200_000) -> DataFrame:
    """A daily series onto the panel; broadcast while it has few dates, counted."""
    return panel.join(F.broadcast(days) if days.count() <= limit else days, "date", "left")


def ensemble(seeds: list[DataFrame], score: str = "pred_score") -> DataFrame:
    """Mean over the seeds of each row's percentile rank in its date."""
    every = seeds[0].select("symbol", "date", score).withColumn("_seed", F.lit(0))
    for i, s in enumerate(seeds[1:], 1):
        every = every.unionByName(s.select("symbol", "date", score).withColumn("_seed", F.lit(i)))
    ranks = every.withColumn("_r", cs.rank(cs.even(score), day=Window.partitionBy("date", "_seed")))
    return ranks.groupBy("symbol", "date").agg(F.avg("_r").alias(score))


def ensemble_columns(table: DataFrame, columns: list[str], score: str = "pred_score") -> DataFrame:
    """ensemble() of seeds that are columns of one table: one exchange by date, whose number of tasks is given, so that a task holds no more than some dates; one kernel ranks a date's columns."""
    keys = table.select("symbol", "date").schema.fields

    def run(day: pa.Table) -> pa.Table:
        ranks = np.column_stack([cs.places(c.to_numpy(zero_copy_only=False).astype(float)) for c in day.columns[2:]])
        n = (~np.isnan(ranks)).sum(axis=1)
        mean = np.divide(np.nansum(ranks, axis=1), n, out=np.full(len(n), np.nan), where=n > 0)
        return day.select(["symbol", "date"]).append_column(score, pa.array(mean, pa.float64(), from_pandas=True))

    rows = table.select("symbol", "date", *(F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(columns))).repartition(shuffle_parts(table.sparkSession), "date")
    return rows.groupBy("date").applyInArrow(run, StructType([*keys, StructField(score, DoubleType())]))


def nullable(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))
