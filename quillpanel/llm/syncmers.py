"""Document fingerprints from closed syncmers: runs of k characters whose smallest inner run of s characters lies at an edge.

Whether a run is chosen depends on its own characters only, so texts that share a passage share its anchors, wherever it stands. A fingerprint holds all anchors with
their positions, so it grows with the text; two fingerprints are matched by anchors that follow in the same order in both. Of any k - s + 1 runs that follow each other
one at least is an anchor, so no step between two is longer; a text's first and last run are anchors too. So a change of one character always changes an anchor.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.simhash import mix

_BASE = np.uint64(0x100000001B3)


def _rolled(signs: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(signs) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out *= _BASE
            out += signs[j : len(signs) - n + 1 + j]
    return mix(out)


def anchors(texts: list[str], k: int = 16, s: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of each text's closed syncmers, and of its first and last k characters, near which no syncmer need lie. A text without one (fewer than k characters, mostly) has one anchor of all its characters, an empty one none."""
    lengths = np.array([len(t) for t in texts], np.int64)
    signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    inner, w = _rolled(signs, s), k - s + 1
    if len(signs) >= k:
        least, span = inner, 1
        while span * 2 <= w:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < w:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        n = len(least)
        at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : w - 1 + n] == least))
        long = lengths >= k
        at = np.union1d(at, np.concatenate(((ends - lengths)[long], (ends - k)[long])))
        owner = np.searchsorted(ends, at, side="right")
        whole = at + k <= ends[owner]
        at, owner = at[whole], owner[whole]
    else:
        at, owner = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            hashes = hashes * _BASE + signs[at + j]
    hashes = mix(hashes)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, end in enumerate(ends.tolist()):
        lo, hi = bounds[i], bounds[i + 1]
        begin = end - int(lengths[i])
        if lo == hi and lengths[i]:
            out.append((np.zeros(1, np.int64), _rolled(signs[begin:end], int(lengths[i]))))
        else:
            out.append((at[lo:hi] - begin, hashes[lo:hi]))
    return out


def fingerprint(position: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows (position, upper half of the hash) of all anchors, in order. None for an empty text."""
    return np.stack([position, (hashes >> np.uint64(32)).astype(np.int64)], axis=1).astype(np.uint32)


def to_text(found: np.ndarray) -> str:
    """Hexadecimal: a byte for the step from each anchor to the next (255 and four bytes more for a longer one), then four bytes for each hash."""
    steps = np.diff(found[:, 0].astype(np.int64), prepend=0)
    if (steps < 255).all():
        head = steps.astype(np.uint8).tobytes()
    else:
        head = b"".join(bytes([x]) if x < 255 else b"\xff" + x.to_bytes(4, "big") for x in steps.tolist())
    return (head + found[:, 1].astype(">u4").tobytes()).hex()


def from_text(text: str) -> np.ndarray:
    data, at, steps = bytes.fromhex(text), 0, []
    while len(data) - at > 4 * len(steps):
        step = data[at]
        at += 1
        if step == 255:
            step, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        steps.append(step)
    return np.stack([np.cumsum(np.array(steps, np.int64)), np.frombuffer(data, ">u4", len(steps), at).astype(np.int64)], axis=1).astype(np.uint32)


def _numbered(high: np.ndarray) -> np.ndarray:
    """Each anchor with how often its hash came before, as one number."""
    order = np.argsort(high, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(high[order]) != 0)))
    before = np.empty(len(high), np.uint64)
    before[order] = np.arange(len(high)) - np.repeat(first, np.diff(np.append(first, len(high))))
    return high.astype(np.uint64) << np.uint64(32) | before


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of anchors (Dice) that match: the longest run of equal hashes whose positions rise in both texts. Two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a[:, 1] == b[:, 1]).all():
        return 1.0
    _, i, j = np.intersect1d(_numbered(a[:, 1]), _numbered(b[:, 1]), assume_unique=True, return_indices=True)
    j = j[np.argsort(i)]
    ends: list[int] = []  # of the shortest-reaching chain of each length
    if (np.diff(j) > 0).all():
        matched = len(j)
    else:
        for x in j.tolist():
            at = bisect_left(ends, x)
            ends[at : at + 1] = [x]
        matched = len(ends)
    return 2 * matched / (len(a) + len(b))


def anchor_table(docs: DataFrame, k: int = 16, s: int = 5) -> DataFrame:
    """(doc_id, position, anchor) of every closed syncmer, for positional matching by a join on anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = anchors([t or "" for t in part.column(1).to_pylist()], k, s)
                counts = [len(p) for p, _ in found]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([p for p, _ in found])), pa.array(np.concatenate([h for _, h in found]).view(np.int64))], names=["doc_id", "position", "anchor"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, position long, anchor long")


def fingerprints(docs: DataFrame, k: int = 16, s: int = 5) -> DataFrame:
    """doc_id and fingerprint (hex; empty for a null or empty text) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [to_text(fingerprint(p, h)) for p, h in anchors([t or "" for t in part.column(1).to_pylist()], k, s)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


_LOWEST = -(2**63)


class Ranges:
    """Ranges of documents by id. An id that fills several ranges is split by the hash of the text, which also orders documents of one id."""

    def __init__(self, cuts: np.ndarray):
        self.cuts, self.parts = np.unique(cuts, return_counts=True)
        self.first = np.concatenate(([0], 1 + np.cumsum(self.parts) - self.parts)).astype(np.int64)
        self.count = 1 + int(self.parts.sum())

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, ids, side="right")
        part = self.first[at]
        below = np.maximum(at - 1, 0)
        many = np.where(at > 0, self.parts[below], 1) if len(self.cuts) else np.ones(len(ids), np.int64)
        same = (at > 0) & (self.cuts[below] == ids) if len(self.cuts) else np.zeros(len(ids), bool)
        place = ((hashes >> 32) + 2**31) * many >> 32
        return part + np.where(same, place, many - 1)


def compare_with_next(docs: DataFrame, k: int = 16, s: int = 5, range_bytes: int = 32 << 20) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document, by ascending doc_id; after the last comes the first.

    The edited text has its last quarter (rounded down) of code points replaced by as many first ones of the next document, or all it has. Null texts are empty;
    null ids come first; rows of equal ids follow by the hash of their text, then the text. Texts are dealt once, to ranges of about `range_bytes`, or fewer bytes where
    there are more shuffle partitions; each range also gets the first document of the next one. A range is read in order and never held whole.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    ranges = Ranges(np.array(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts), np.float64).astype(np.int64))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = ranges.of(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", "doc_id", "hash"])

    firsts = docs.select("doc_id", "hash").mapInArrow(numbered, "part long, doc_id long, hash long").groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("f"))
    firsts = sorted((r["part"], tuple(r["f"])) for r in firsts.collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the range that a range's first document visits
    visitors = np.unique(np.array([i for i, _ in before], np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "visit", "doc_id", "none", "text", "hash"]
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "hash"))
            yield pa.RecordBatch.from_arrays([pa.array(ranges.of(ids, hashes)), pa.array(np.zeros(len(ids), np.int32)), *batch.columns], names=names)
            away = [i for i in np.flatnonzero(np.isin(ids, visitors)).tolist() if (int(ids[i]), int(hashes[i])) in before]
            if away:
                hosts = [before[int(ids[i]), int(hashes[i])] for i in away]
                yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(np.ones(len(away), np.int32)), *batch.take(pa.array(away)).columns], names=names)

    dealt = docs.mapInArrow(deal, "part long, visit int, doc_id long, none boolean, text string, hash long")
    dealt = dealt.repartitionById(ranges.count, F.col("part").cast("int")).sortWithinPartitions("part", "visit", "doc_id", "hash", "text")
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        held: deque = deque()  # rows of one range that wait for their next document
        part, ended = None, True

        def flush(keep: int) -> pa.RecordBatch | None:
            """Compares all held rows but the last `keep`, which is only looked at."""
            rows = list(held)
            if len(rows) < 2:
                return None
            texts = [t for _, _, t in rows]
            edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, texts[1:], strict=False)]
            found = [fingerprint(p, h) for p, h in anchors(texts + edited, k, s)]
            own, made = found[: len(texts)], found[len(texts) :]
            out = [
                (None if none else i, len(t), sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), to_text(a), to_text(b), likeness(a, b), likeness(a, c))
                for (i, none, t), e, a, b, c in zip(rows[:-1], edited, own[:-1], made, own[1:], strict=True)
            ]
            held.clear()
            held.extend(rows[len(rows) - keep :])
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

        chars = 0
        for batch in batches:
            for p, visit, doc_id, none, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if p != part:
                    held.clear()
                    part, ended, chars = p, False, 0
                if ended:
                    continue  # a repeated row of the visiting document
                held.append((doc_id, none, text.as_py()))
                chars += len(held[-1][2])
                ended = visit == 1
                if ended or chars > 200_000:
                    made = flush(0 if ended else 1)
                    chars = 0
                    if made is not None:
                        yield made

    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
