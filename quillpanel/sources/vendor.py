"""A market-data service as a Spark source: one partition for a group of symbols, filters that reach the service, and retries that respect its rate limit."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: fetch(symbols, first, last) gives the rows of some symbols between two dates (None: no bound), in the source's columns. It runs in Spark's tasks.
Fetch = Callable[[list, "date | None", "date | None"], pa.Table]


def wait_of(message: str, otherwise: float) -> float:
    """Seconds that a rate-limit message asks to wait."""
    found = re.search(r"(\d+)\s*(?:seconds?|s\b)", message)
    return float(found[1]) if found else otherwise


def attempt(fetch: Callable[[], pa.Table], attempts: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> pa.Table:
    """What fetch gives, tried again after the wait that its error names, or twice as long each time; the last error is raised."""
    for n in range(attempts):
        try:
            return fetch()
        except Exception as e:
            if n + 1 == attempts:
                raise
            sleep(wait_of(str(e), wait * 2**n))
    raise ValueError("at least one attempt")


class Group(InputPartition):
    def __init__(self, symbols: list):
        self.symbols = symbols


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, symbols: list, fetch: Fetch, groups: int, attempts: int, wait: float):
        self.schema, self.symbols, self.fetch, self.groups, self.attempts, self.wait = schema, symbols, fetch, groups, attempts, wait
        self.first: date | None = None
        self.last: date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Symbols and inclusive date bounds are taken; strict bounds narrow what is fetched, but Spark tests them again, like all other filters."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("symbol",) and isinstance(f, EqualTo):
                self.symbols = [s for s in self.symbols if s == f.value]
            elif column == ("symbol",) and isinstance(f, In):
                self.symbols = [s for s in self.symbols if s in f.value]
            elif column == ("date",) and isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan | LessThanOrEqual | LessThan):
                if not isinstance(f, LessThanOrEqual | LessThan):
                    self.first = f.value if self.first is None else max(self.first, f.value)
                if not isinstance(f, GreaterThanOrEqual | GreaterThan):
                    self.last = f.value if self.last is None else min(self.last, f.value)
                if isinstance(f, GreaterThan | LessThan):
                    yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        size = max(1, -(-len(self.symbols) // self.groups))
        return [Group(self.symbols[i : i + size]) for i in range(0, len(self.symbols), size)] or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if partition.symbols:
            yield from attempt(lambda: self.fetch(partition.symbols, self.first, self.last), self.attempts, self.wait).to_batches()


def scan(spark: SparkSession, name: str, schema: str, symbols: list, fetch: Fetch, groups: int = 8, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows of a universe of symbols (columns symbol and date among them) as a table; a filter on either narrows what is fetched. A repeated symbol is fetched once."""
    universe = sorted(set(symbols))

    class Service(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(schema, universe, fetch, groups, attempts, wait)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Service)
    return spark.read.format(name).load()
