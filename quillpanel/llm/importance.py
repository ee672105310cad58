"""Target-distribution importance resampling over bucket-partitioned inverted postings (hashed n-gram features, Gumbel top-k draw).

Each task turns its texts into postings (bucket, document, count), packed by block (some megabytes of text) and part (a share of the buckets). The postings are dealt
by part and salt, together with both corpora's counts of the part's buckets, so every gain is computed where its postings are. What comes out, one sum for each document
of a block and part, is added up by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import local, save, slices
from quillpanel.llm.decontam import words_of

#: part of a row that lists a block's documents, and of a row with the bucket counts of a whole task.
DOCUMENTS, COUNTS = -1, -2
SCHEMA = "part int, block long, n long, doc_ids array<long>, n_words array<long>, n_features array<long>, buckets binary, docs binary, counts binary, totals array<long>"


def features_of(words: list[bytes], runs: int, buckets: int, step: int = 50_000) -> np.ndarray:
    """The bucket of every run of 1 to `runs` consecutive words, repeats included. A longer run's checksum goes on from the shorter one's. `step` words are taken at a time."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(words), step):
        sums = [zlib.crc32(w) for w in words[at : at + step]]
        out.append(np.array(sums, np.int64) % buckets)
        for n in range(1, runs):
            sums = [zlib.crc32(b" " + w, c) for w, c in zip(words[at + n : at + n + step], sums, strict=False)]
            out.append(np.array(sums, np.int64) % buckets)
    return np.concatenate(out).astype(np.int32)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, each in 1, 2 or 4 bytes, as the largest needs."""
    top = int(values.max(initial=0))
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}")


def postings(docs: DataFrame, runs: int, buckets: int, parts: int, size: int = 2_000_000) -> DataFrame:
    """The rows of SCHEMA for docs (doc_id, text): for each block one that lists its documents and one for each part with postings; for each task one with its counts."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "n_words", "n_features")), *((c, pa.binary()) for c in ("buckets", "docs", "counts")), ("totals", pa.list_(pa.int64()))])

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, totals = TaskContext.get().partitionId() << 32, np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, 1, size):
                found, n_words = [], []
                for text in piece.column(1):
                    words = words_of(text.as_py())
                    found.append(features_of(words, runs, buckets))
                    n_words.append(len(words))
                n = [len(f) for f in found]
                key, count = np.unique(np.repeat(np.arange(len(n)), n) * buckets + np.concatenate(found), return_counts=True)
                doc, bucket = key // buckets, key % buckets
                totals += np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
                out = [{"part": DOCUMENTS, "block": block, "doc_ids": piece.column(0).to_pylist(), "n_words": n_words, "n_features": n}]
                for part in range(parts):
                    mine = np.flatnonzero(bucket % parts == part)
                    if len(mine):
                        columns = {"buckets": bucket, "docs": doc, "counts": count}
                        out.append({"part": part, "block": block, "n": len(mine)} | {k: packed(v[mine]) for k, v in columns.items()})
                yield rows(out)
                block += 1
        yield rows([{"part": COUNTS, "block": block, "totals": totals.tolist()}])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def bucket_counts(posted: DataFrame) -> DataFrame:
    """bucket, n: added up from the tasks' counts, so at most one row for each bucket and task is shuffled."""
    return posted.where(F.col("part") == COUNTS).select(F.posexplode("totals").alias("bucket", "n")).where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(s: int, t: int, S: int, T: int, buckets: int) -> int:
    """1000 times the log of how much likelier the bucket is in the target (add-one smoothing), floored."""
    return math.floor(1000 * math.log(float(t + 1) * float(S + buckets) / (float(s + 1) * float(T + buckets))))


def contributions(posted: DataFrame, counts: DataFrame, S: int, T: int, buckets: int, parts: int) -> DataFrame:
    """block, pos (of the document in it), total: the part of a document's gains that one part of the buckets makes up.

    A part's blocks are dealt over salts, about sixteen for each, since a part with a very common bucket may hold most postings; the part's counts (buckets / parts
    entries) go to each of its salts. Sorted, the counts come first and the blocks stream past them, so a task holds one block at a time.
    """
    blocks = posted.where(F.col("part") == DOCUMENTS).count()
    salts = max(1, blocks // 16)
    both = counts.groupBy(F.pmod("bucket", F.lit(parts)).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("bucket", "s", "t"))).alias("known"))
    both = both.select("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("block"), "known")
    dealt = posted.where(F.col("part") >= 0).select("part", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "n", "buckets", "docs", "counts")
    together = both.unionByName(dealt, allowMissingColumns=True).repartition("part", "salt").sortWithinPartitions("part", "salt", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, at = np.zeros(buckets, np.int64), None
        for batch in batches:
            blocks, sums, ends = [], [np.zeros(0, np.int64)], [0]
            for row in range(batch.num_rows):
                part, block, known, n, bucket, doc, count = (c[row] for c in batch.columns)
                if block.as_py() < 0:
                    at = part.as_py()
                    for k in known.as_py():
                        gains[k["bucket"]] = gain(k["s"], k["t"], S, T, buckets)
                    continue
                assert at == part.as_py()
                bucket, doc, count = (unpacked(c.as_buffer(), n.as_py()) for c in (bucket, doc, count))
                sums.append(np.bincount(doc, weights=gains[bucket] * count.astype(np.float64)).astype(np.int64))
                ends.append(ends[-1] + len(sums[-1]))
                blocks.append(block.as_py())
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sums)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), values], names=["block", "sums"])

    return together.select("part", "block", "known", "n", "buckets", "docs", "counts").mapInArrow(run, "block long, sums array<long>").select("block", F.posexplode("sums").alias("pos", "total"))


def importance(docs: DataFrame, target: DataFrame, runs: int = 2, buckets: int = 10_000, parts: int = 16, block_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, block, pos, n_words, n_features and weight (the floored mean of its features' gains, 0 without features) of each row of docs; block and pos number the rows.

    docs needs doc_id and text, target a text; other columns are ignored. A null text has no words. Repeated rows count as often as they stand there and each give a
    row. With an empty target all of its counts are 0. The postings are written once, so numbers of blocks stay what they are if a task runs again.
    """
    posted = save(postings(docs, runs, buckets, parts, block_bytes), "importance-postings")
    aimed = bucket_counts(postings(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets, parts))
    counts = bucket_counts(posted).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(aimed.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = save(counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "importance-counts")
    S, T = (int(v or 0) for v in counts.agg(F.sum("s"), F.sum("t")).first())
    listed = posted.where(F.col("part") == DOCUMENTS).select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words", "n_features")).alias("pos", "d")).select("block", "pos", "d.*")
    rows = listed.select("block", "pos", F.col("doc_ids").alias("doc_id"), "n_words", "n_features", F.lit(0).cast("long").alias("total"))
    rows = rows.unionByName(contributions(posted, counts, S, T, buckets, parts), allowMissingColumns=True)
    rows = rows.groupBy("block", "pos").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("n_features").alias("n_features"), F.sum("total").alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return rows.select("doc_id", "block", "pos", "n_words", "n_features", weight.cast("long").alias("weight"))


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, seed: int = 7, **options) -> DataFrame:
    """importance() with score (weight plus Gumbel noise from a hash of seed and id, in thousandths) and rank: the `share` of a hundred of the documents with at least
    `least_words` words that score highest are numbered from 1, ties by the smaller doc_id (a null id last); others have a null rank.

    A null id draws as an empty one. Rows with one id draw alike; if they tie in all, their order follows the table's. The order is a range partitioning of small
    rows; a partition's first rank is the number of rows before it, so no task sees all.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = save(importance(docs, target, **options).withColumn("score", (F.col("weight") + noise).cast("long")), "importance-scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * share // 100
    placed = save(scored.orderBy((~able).cast("int"), F.desc("score"), F.asc_nulls_last("doc_id"), "block", "pos").withColumn("at", F.monotonically_increasing_id()), "importance-order")
    step = F.shiftright("at", 33)
    begins, before = [], 0
    for r in placed.groupBy(step.alias("k")).count().orderBy("k").collect():  # one row for each partition
        begins.append((r["k"], before))
        before += r["count"]
    begins = local(docs.sparkSession, begins, [pa.int64(), pa.int64()], ["k", "before"])
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = placed.join(F.broadcast(begins), step == F.col("k"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(able & (rank <= drawn), rank).alias("rank"), "n_words")
