"""Benchmark decontamination: an FM-index for each shard of the training text, searched backwards.

A shard is what one task has read of the documents until enough words have come together. Words that no benchmark item has cannot lie in an occurrence, so only
runs of benchmark words, as long as the shortest window at least, go into the index; this loses no occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import save

#: A-Z to a-z; what is neither a digit, a letter nor beyond ASCII becomes a space.
_WORD_BYTES = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one array of running zero counts for each bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.totals = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            zeros = np.concatenate(([0], np.cumsum(bit == 0, dtype=np.int32)))
            self.zeros.append(zeros)
            self.totals.append(int(zeros[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin, end = np.zeros_like(at), at
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            zeros, one = self.zeros[i], ((symbol >> level) & 1).astype(bool)
            zb, ze = zeros[begin], zeros[end]
            begin = np.where(one, self.totals[i] + begin - zb, zb)
            end = np.where(one, self.totals[i] + end - ze, ze)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for i in range(self.bits):
            zeros = self.zeros[i]
            one = zeros[at + 1] == zeros[at]
            symbol = symbol * 2 + one
            at = np.where(one, self.totals[i] + at - zeros[at], zeros[at])
        return symbol


class FMIndex:
    """Over runs of symbols from 1 up; 0 ends each run. Every `every`-th suffix position and each start of a run is sampled."""

    def __init__(self, runs: list[np.ndarray], every: int = 8):
        lengths = np.array([len(r) for r in runs])
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        seq = np.concatenate([x for r in runs for x in (r, np.zeros(1, r.dtype))]).astype(np.int64)
        order = self._suffixes(seq, len(runs))
        bwt = seq[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(seq.max()).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=int(seq.max()) + 2))))
        self.size = len(seq)
        sampled = np.zeros(len(seq), bool)
        sampled[::every] = True
        sampled[self.starts] = True
        self.marked = sampled[order]
        self.before = np.concatenate(([0], np.cumsum(self.marked)))
        self.samples = order[self.marked]

    @staticmethod
    def _suffixes(seq: np.ndarray, runs: int) -> np.ndarray:
        """Prefix doubling; the ends of runs differ from each other, so it stops at the longest run."""
        rank = np.where(seq == 0, np.cumsum(seq == 0) - 1, seq + runs - 1)
        _, rank = np.unique(rank, return_inverse=True)
        n, step = len(seq), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * np.int64(n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            rank, step = new, step * 2
            if rank[order[-1]] == n - 1 or step >= n:
                return order

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all the patterns (rows, padded at the end) at once: first and last+1 row of each one's suffixes."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        top = len(self.first) - 2
        live = np.arange(len(patterns))
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = live[lo[live] < hi[live]]
            step = live[lengths[live] >= back]
            if not len(step):
                break
            symbol = patterns[step, lengths[step] - back]
            known = (symbol > 0) & (symbol <= top)
            hi[step[~known]] = lo[step[~known]]
            step, symbol = step[known], symbol[known]
            base = self.first[symbol]
            lo[step], hi[step] = base + self.wavelet.rank(symbol, lo[step]), base + self.wavelet.rank(symbol, hi[step])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks back to a sampled suffix."""
        at, walked, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.marked[at[left]]
            hit = left[done]
            out[hit] = self.samples[self.before[at[hit]]] + walked[hit]
            left = left[~done]
            symbol = self.wavelet.access(at[left])
            at[left] = self.first[symbol] + self.wavelet.rank(symbol, at[left])
            walked[left] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items: distinct word sequences, each with its items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for at in range(max(1, len(symbols) - window + 1) if symbols else 0):
                found.setdefault(tuple(symbols[at : at + window]), set()).add(item)
        self.items = list(found.values())
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.shortest = int(self.lengths.min(initial=window))
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, w in zip(self.patterns, found, strict=True):
            row[: len(w)] = w


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((begin, end))
    return merged


def _search_shard(phrases: Phrases, runs: list[np.ndarray], places: list[tuple[int, int]]) -> dict[int, tuple[list, set]]:
    """Spans and items of each document of a shard. places: document and first word of each run."""
    index = FMIndex(runs)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    counts = hi[found] - lo[found]
    which = np.repeat(found, counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = index.locate(lo[which] + offset)
    run = np.searchsorted(index.starts, at, side="right") - 1
    out: dict[int, tuple[list, set]] = {}
    for w, r, begin in zip(which.tolist(), run.tolist(), (at - index.starts[run]).tolist(), strict=True):
        doc, first = places[r]
        spans, items = out.setdefault(doc, ([], set()))
        spans.append((first + begin, first + begin + int(phrases.lengths[w])))
        items.update(phrases.items[w])
    return out


SCHEMA = "row long, doc_id long, n_words long, spans array<struct<begin: long, end: long>>, items array<string>"


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 200_000, block_words: int = 2_000_000) -> DataFrame:
    """Per document: n_words, the merged removal spans (word offsets, end excluded) and the benchmark items that occur.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. A null or empty text has no words and no spans; an item without words has
    no window; items with a null id count as one, which is null in `items` too. Repeated rows of documents each give a row, repeated items count once by id. No item
    crosses a document's end. The benchmark is read in blocks of block_words words by hash of the item, each broadcast and searched in a pass of its own, so no broadcast
    grows with it. With several blocks the documents are written once with a number for each row, and what the passes find is put together by that number, so rows
    that share an id, or have none, stay apart; a number has one row of each block at most.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split(F.col("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    docs = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if blocks > 1:
        docs = save(docs.withColumn("row", F.monotonically_increasing_id()), "decontamination-rows")
    passes = []
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        passes.append(_pass(docs, Phrases([(r[0], r[1]) for r in mine], window), shard_words))
    if blocks == 1:
        return passes[0].drop("row")
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more.where(F.size("spans") > 0))
    merged = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    return merged.select("doc_id", "n_words", _merge(F.array_sort("s")).alias("spans"), F.array_distinct("i").alias("items"))


def _merge(spans):
    """merge_spans on a sorted array column."""
    kind = "array<struct<begin: long, end: long>>"
    last = lambda acc: F.element_at(acc, -1)
    touch = lambda acc, x: (F.size(acc) > 0) & (x["begin"] <= F.try_element_at(acc, F.lit(-1))["end"])
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    return F.aggregate(spans, F.array().cast(kind), lambda acc, x: F.when(touch(acc, x), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))


def _pass(docs: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def rows(held: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"row": [h[0] for h in held], "doc_id": [h[1] for h in held], "n_words": [h[2] for h in held], "spans": [[{"begin": b, "end": e} for b, e in h[3]] for h in held], "items": [h[4] for h in held]},
            schema=schema,
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        known, shortest = phrases.ids.get, phrases.shortest
        held: list[list] = []
        runs: list[np.ndarray] = []
        places: list[tuple[int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, runs, places, size
            if runs:
                for doc, (spans, items) in _search_shard(phrases, runs, places).items():
                    held[doc][3:] = merge_spans(spans), list(items)
            out, held, runs, places, size = rows(held), [], [], [], 0
            return out

        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text.as_py())
                held.append([row, doc_id, len(words), [], []])
                if phrases.items and len(words) >= shortest:
                    ids = np.fromiter((known(w, 0) for w in words), np.int64, len(words))
                    gaps = np.flatnonzero(np.concatenate(([0], ids, [0])) == 0)
                    for k in np.flatnonzero(np.diff(gaps) > shortest):
                        begin, end = int(gaps[k]), int(gaps[k + 1]) - 1
                        runs.append(ids[begin:end])
                        places.append((len(held) - 1, begin))
                        size += end - begin
                if size >= shard_words or len(held) >= 20_000:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(search, SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, **options) -> DataFrame:
    """benchmark_spans() with the digest columns: n_hit, n_items, items_sha256, contaminated (a twentieth of the words at least). A null item is written as null in the digest."""
    found = benchmark_spans(docs, benchmark, window, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    found, names = found.withColumn("n_hit", hit), F.array_sort(F.transform("items", lambda x: F.coalesce(x, F.lit("null"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
