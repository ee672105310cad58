"""Walk-forward folds: positions on the sorted dates, as a small table that is range-joined with the panel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def test_length(initial: int, gap: int, ratio: float) -> int:
    """Dates of a test window so that training has `ratio` of both together; half to even, one at least."""
    return max(1, round((initial - gap) * (1 - ratio) / ratio))


@dataclass(frozen=True)
class Windows:
    """Slices (train begin, train end, test begin, test end) of date positions; ends are excluded, incomplete last folds dropped."""

    initial: int
    gap: int = 21
    ratio: float = 0.8

    def __post_init__(self) -> None:
        if self.initial < 1 or not 0 <= self.gap < self.initial:
            raise ValueError("initial must be positive, and gap from 0 to below it")
        if not 0 < self.ratio < 1:
            raise ValueError("ratio lies between 0 and 1")

    def slices(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        raise NotImplementedError


class Rolling(Windows):
    """The training window moves on by the length of a test."""

    def slices(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        step = test_length(self.initial, self.gap, self.ratio)
        for s in range(0, n - self.initial - step + 1, step):
            yield s, s + self.initial - self.gap, s + self.initial, s + self.initial + step


class Expanding(Windows):
    """The training window begins at the first date and grows."""

    def slices(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        step = test_length(self.initial, self.gap, self.ratio)
        for b in range(self.initial, n - step + 1, step):
            yield 0, b - self.gap, b, b + step


def date_index(panel: DataFrame) -> DataFrame:
    """(date, i): dates are few, so one sorted run numbers them."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def fold_table(panel: DataFrame, windows: Windows) -> DataFrame:
    """(fold, train_lo, train_hi, test_lo, test_hi) as inclusive dates."""
    spark = panel.sparkSession
    dates = date_index(panel)
    slices = list(windows.slices(dates.count()))
    rows = spark.createDataFrame([(k, a, b - 1, c, d - 1) for k, (a, b, c, d) in enumerate(slices)], "fold int, a int, b int, c int, d int")
    for x, name in (("a", "train_lo"), ("b", "train_hi"), ("c", "test_lo"), ("d", "test_hi")):
        rows = rows.join(dates.select(F.col("i").alias(x), F.col("date").alias(name)), x)
    return rows.select("fold", "train_lo", "train_hi", "test_lo", "test_hi")


def assign(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The panel's rows in each fold's training or test part; a row may train several folds. Folds are a handful, so they are broadcast."""
    within = F.col("date").between(F.col("train_lo"), F.col("train_hi")) | F.col("date").between(F.col("test_lo"), F.col("test_hi"))
    part = F.when(F.col("date") >= F.col("test_lo"), "test").otherwise("train").alias("part")
    return panel.join(F.broadcast(folds), within).select(*panel.columns, "fold", part)


def split(panel: DataFrame, start: date, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """Training rows end `days` calendar days before the test begins."""
    return panel.where(F.col("date") < F.lit(start - timedelta(days=days))), panel.where(F.col("date") >= F.lit(start))
