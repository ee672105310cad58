"""Helpers shared by the operators: shared storage, folds, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one on one machine (tests), and an error on a cluster, whose executors would not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillpanel-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read again, so a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5; a null id is in no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def strings(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch cut where its texts come to `size` bytes, so that what a task holds of them stays bounded by that and the longest text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def without(docs: DataFrame, ids: DataFrame, name: str, broadcast_rows: int = 500_000) -> DataFrame:
    """docs whose doc_id is not among ids (a column doc_id). The ids are broadcast if they are counted to be few, else both sides are shuffled."""
    ids = save(ids.select(F.col("doc_id").alias("_gone")), name)
    few = ids.count() <= broadcast_rows
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_gone"), "left_anti")


def local(spark: SparkSession, rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> DataFrame:
    """A table of a few rows, by way of Arrow: from tuples Spark would start Python workers of a second kind, which then stay in every executor."""
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker gives memory back to the system: it lives on for other tasks, and so would the memory of its largest one."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def bounded_sample(rows: DataFrame, name: str, per_label: int, most_bytes: int) -> list[tuple]:
    """(id, text, label) in order of id, text and label, for the driver to fit on: of rows (id, label, text) at most `per_label` ids of each label and `most_bytes` of UTF-8 in all.

    An id that repeats counts once for each label, with the text of the smallest hash: tasks keep one text of an id before and after the shuffle, without a sort, so a hot
    id is never more than a text in each. Ids come in order of their hash; a text too long for what is left is passed over.
    """

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for key, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                if text.is_valid:
                    data = text.as_buffer().to_pybytes()
                    order = (xxhash.xxh64_intdigest(data), data)
                    if key not in best or order < best[key]:
                        best[key] = order
        for (i, label), (_, data) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], kinds[0]), pa.array([label], kinds[1]), pa.array([data], pa.binary()).cast(pa.string())], names=["id", "label", "text"])

    rows = rows.select("id", "label", "text")
    kinds = [to_arrow_type(f.dataType) for f in rows.schema.fields]
    once = save(rows.mapInArrow(one_each, rows.schema).repartition(8, "id", "label").mapInArrow(one_each, rows.schema), name)
    taken: dict = {}
    passed = []
    sizes = once.select("id", "label", F.octet_length("text").alias("n"), F.xxhash64("id").alias("h")).collect()
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"], r["label"])):
        if taken.get(r["label"], 0) < per_label and r["n"] <= most_bytes:
            taken[r["label"]] = taken.get(r["label"], 0) + 1
            most_bytes -= r["n"]
        else:
            passed.append((r["id"], r["label"]))
    if passed:
        gone = local(rows.sparkSession, passed, kinds[:2], ["id", "label"])
        once = once.join(F.broadcast(gone), ["id", "label"], "left_anti")
    return sorted((r["id"], r["text"], r["label"]) for r in once.collect())


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its columns but doc_id and text under names that no operator uses, and the columns that bring the old names back."""
    names = {c: c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def most_frequent(counts: DataFrame, n: str, size: int) -> DataFrame:
    """The `size` rows (word, ...) of the largest n, ties by word. Rows below a bound that enough words reach are left out first, so a task sends only what it needs to."""
    grid = counts.groupBy(F.floor(F.log2(n) * 16).alias("g")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("g")).collect()
    total, least = 0, 0.0
    for row in grid:
        total += row["k"]
        if total >= size:
            least = 2 ** (row["g"] / 16) * (1 - 1e-9)
            break
    return counts.where(F.col(n) >= least).orderBy(F.desc(n), "word").limit(size)
