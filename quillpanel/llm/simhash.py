"""SimHash near-duplicates: BK-trees over shards of the distinct fingerprints.

All trees cannot be broadcast: they grow with the corpus, and building them at the driver would gather every fingerprint there. So each shard of fingerprints
goes to one task by a shuffle, which builds the shard's tree and looks up the shard's own members in it, following only edges within the radius.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillpanel.llm.common import save, slices, tidy
from quillpanel.llm.graph import components

#: The odd constants of the public splitmix64 generator.
_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: well-spread 64-bit values from 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * _MIX_A
        x = (x ^ (x >> np.uint64(27))) * _MIX_B
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words, repeats included; A-Z are lower-cased, ASCII white space separates words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e - 1 for e in itertools.accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(n, len(words)) - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray, wide: int = 1) -> np.ndarray:
    """wide words of 64 bits; a bit is 1 if over half the hashes have it. Further words take the bits of mixed hashes."""
    out = np.zeros(wide, np.uint64)
    for i in range(wide if len(hashes) else 0):
        h = hashes if i == 0 else mix(hashes ^ np.uint64(i))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            ones += np.unpackbits(h[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def _names(wide: int) -> list[str]:
    return [f"f{i}" for i in range(wide)]


def _longs(names: list[str]) -> StructType:
    return StructType([StructField(n, LongType()) for n in names])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and the fingerprint f0 of each document, as a signed long. Texts without words have zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), shingle))[0] for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "f0"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _longs(["doc_id", "f0"]))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class BKForest:
    """A BK-tree for each group of fingerprints (rows; equal groups adjacent). A child's key is its integer Hamming distance to its parent.

    All the trees grow and are searched level by level in numpy; the result is the tree that inserting a group's rows one by one gives.
    """

    def __init__(self, group: np.ndarray, rows: np.ndarray):
        self.rows, n = rows, len(rows)
        self.wide = rows.shape[1] * 64 + 1
        first = np.concatenate(([True], group[1:] != group[:-1])) if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        keys, nodes = [], []
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):
            key = at * self.wide + distance(rows[item], rows[at])
            order = np.argsort(key, kind="stable")
            key, item = key[order], item[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            keys.append(key[new])
            nodes.append(item[new])
            owner = item[np.maximum.accumulate(np.where(new, np.arange(len(item)), 0))]
            item, at = item[~new], owner[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.nodes = key[order], (np.concatenate(nodes) if nodes else key)[order]

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, row of its group) at the radius or less, the row itself included."""
        hits, node = [], self.root[query]
        while len(query):
            d = distance(self.rows[query], self.rows[node])
            near = d <= radius
            hits.append((query[near], node[near]))
            lo = np.searchsorted(self.keys, node * self.wide + np.maximum(d - radius, 0), "left")
            count = np.searchsorted(self.keys, node * self.wide + np.minimum(d + radius, self.wide - 1), "right") - lo
            query = np.repeat(query, count)
            node = self.nodes[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(query))]
        return (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])) if hits else (query, query)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest member's index) after each a and b have been joined."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def link_groups(group: np.ndarray, rows: np.ndarray, radius: int, pairs: int = 1 << 20) -> np.ndarray:
    """Each row's label: the first row of what it reaches inside its group over links of at most the radius. Links are joined at once, never listed.

    Rows are searched in blocks that meet `pairs` rows of their groups at most (or are one row), so the search's memory doesn't follow the size of a group.
    """
    labels, forest = np.arange(len(rows)), BKForest(group, rows)
    met = np.cumsum(np.bincount(group, minlength=1)[group]) if len(rows) else np.zeros(0, np.int64)
    at = 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(met, (met[at - 1] if at else 0) + pairs, side="right")))
        a, b = forest.within(np.arange(at, end), radius)
        labels = join_labels(labels, a[a > b], b[a > b])
        at = end
    return labels


def block_masks(count: int, radius: int, tree: int = 64) -> np.ndarray:
    """Masks of which two fingerprints of 64 bits within the radius agree on one at least: `agree` of agree + radius blocks, so few that a shard holds about `tree` rows."""
    agree = 1
    while agree < 4 and count / 2 ** (64 * agree / (agree + radius)) > tree:
        agree += 1
    edges = [round(64 * i / (agree + radius)) for i in range(agree + radius + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in itertools.pairwise(edges)]
    return np.array([[sum(c)] for c in itertools.combinations(blocks, agree)], np.uint64)


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash of a set: a key for each band, of the smallest hashes under `rows` orders. Sets of likeness J agree on one band at least with probability 1 - (1 - J^rows)^bands."""
    least = np.zeros(bands * rows, np.uint64)
    if len(hashes):
        factors, least = mix(np.arange(bands * rows, dtype=np.uint64)) | np.uint64(1), ~least
        for at in range(0, len(hashes), 4096):
            least = np.minimum(least, (hashes[at : at + 4096, None] * factors).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for part in least.reshape(bands, rows).T:
        key = mix(key ^ part)
    return key


def links(nodes: DataFrame, masks: np.ndarray, radius: int, tile: int = 8192) -> DataFrame:
    """Edges (a, b) between nodes (node, f0...): in each shard a star for each set of nodes that links of at most the radius join, never all pairs. A shard is what agrees on one mask."""
    wide = masks.shape[1]
    names = ["node", *_names(wide)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = np.stack([part.column(1 + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(wide)], axis=1)
                key = np.zeros((len(masks), len(rows)), np.uint64)
                for i in range(wide):
                    key = mix(key ^ (rows[:, i][None, :] & masks[:, i][:, None]))
                key = mix(key ^ np.arange(len(masks), dtype=np.uint64)[:, None]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(np.tile(c.to_numpy(zero_copy_only=False), len(masks))) for c in part.columns)], names=["shard", *names])

    return link_shards(nodes.select(*names).mapInArrow(deal, _longs(["shard", *names])), wide, radius, tile)


def band_links(nodes: DataFrame, wide: int, bands: int, radius: int, tile: int = 8192) -> DataFrame:
    """links() with shards of what agrees on one band: nodes have node, f0... and m0..., the keys of the bands."""
    names, keys = ["node", *_names(wide)], [f"m{i}" for i in range(bands)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.slice(at, 2000).columns]
                rest, key = columns[: len(names)], columns[len(names) :]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), *(pa.array(np.tile(c, bands)) for c in rest)], names=["shard", *names])

    return link_shards(nodes.select(*names, *keys).mapInArrow(deal, _longs(["shard", *names])), wide, radius, tile)


def link_shards(dealt: DataFrame, wide: int, radius: int, tile: int) -> DataFrame:
    """The edges of links() from rows (shard, node, f0...). A shard of more than `tile` rows is cut into parts by hash, and each pair of parts meets in a group of its own."""
    names, spark = ["node", *_names(wide)], dealt.sparkSession
    hot = save(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("shard", F.ceil(F.col("n") / tile).cast("long").alias("parts")), "hot-shards")
    if hot.isEmpty():
        dealt = dealt.withColumn("tile", F.lit(0).cast("long"))
    else:
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
        dealt = dealt.join(hot, "shard", "left").withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("parts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("shard", "tile", *names).repartition(parts, "shard", "tile").sortWithinPartitions("shard", "tile", *names[1:])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def edges(data: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum((data[1:, :2] != data[:-1, :2]).any(axis=1))))
            labels = link_groups(group, data[:, 3:].view(np.uint64), radius)
            to = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(data[to, 2]), pa.array(data[labels[to], 2])], names=["a", "b"])

        for batch in batches:
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            data = data if rest is None else np.concatenate((rest, data))
            cut = np.flatnonzero((data[:, :2] != data[-1, :2]).any(axis=1))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield edges(np.ascontiguousarray(data[:cut]))
            rest = data[cut:]
        if rest is not None and len(rest):
            yield edges(np.ascontiguousarray(rest))

    return dealt.mapInArrow(link, _longs(["a", "b"]))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, f0 and component_id of each document: the smallest doc_id that links of at most `radius` differing bits reach, its own included.

    docs needs doc_id and text; other columns are ignored. Null, empty and white texts have the zero fingerprint, linked like any other; texts with fewer words
    than a shingle are one shingle. Repeated rows each give a row; a null doc_id takes part, but is no component_id where another is there. Blocks of bits lose no link.
    """
    found = save(fingerprints(docs, shingle), "fingerprints").withColumn("node", F.col("f0"))
    nodes = save(found.groupBy("node", "f0").agg(F.min("doc_id").alias("least")), "nodes")
    return _members(found, nodes, links(nodes, block_masks(nodes.count(), radius), radius)).select("doc_id", "f0", "component_id")


def _members(found: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """found, a row for each document, with the component_id of its node."""
    joined = components(edges).join(nodes.select("node", "least"), "node")
    smallest = joined.groupBy("label").agg(F.min("least").alias("component"))
    joined = joined.join(smallest, "label").select("node", "component")
    member = save(nodes.join(joined, "node", "left").select("node", F.coalesce("component", "least").alias("component_id")), "members")  # so that the join below has two exchanges, and a hot node can be split
    return found.join(member, "node", "left")


def hex_of(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def expected_loss(likeness: float, wide: int = 4, radius: int = 80, bands: int = 20, rows: int = 4) -> float:
    """The share of pairs of that likeness which copies() does not compare: they agree on no band, or their fingerprints differ in more bits than the radius."""
    p, n = math.acos(2 * likeness / (1 + likeness)) / math.pi, wide * 64
    far = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(radius + 1, n + 1))
    return 1 - (1 - (1 - likeness**rows) ** bands) * (1 - far)


def set_links(sets: list[np.ndarray], over: int = 4, under: int = 5) -> np.ndarray:
    """Each set's label: the first set that it reaches over pairs whose exact Jaccard likeness is over / under or more. Sets hold no value twice and none is empty.

    A set is compared only with those that no component has yet, and which have one of its rarest values; it has so many of them that a set without any cannot be alike.
    """
    count, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    starts, holders = np.cumsum(sizes) - sizes, np.repeat(np.arange(count), sizes)[np.argsort(token, kind="stable")]
    held = np.bincount(token, minlength=len(values))
    first = np.cumsum(held) - held
    labels, free, mark = np.arange(count), np.ones(count, bool), np.zeros(len(values), bool)

    def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())

    left = count
    for root in range(count):
        if not free[root]:
            continue
        free[root], left, queue = False, left - 1, [root]
        for q in queue:
            if not left:
                return labels
            own = token[starts[q] : starts[q] + sizes[q]]
            rare = own[np.argsort(held[own], kind="stable")[: sizes[q] * (under - over) // under + 1]]
            if held[rare].sum() < left:
                found = holders[ranges(first[rare], held[rare])]
                found = np.unique(found[free[found]])
            else:
                found = np.flatnonzero(free)
            found = found[(sizes[found] * under >= over * sizes[q]) & (sizes[q] * under >= over * sizes[found])]
            if not len(found):
                continue
            mark[own] = True
            common = np.add.reduceat(mark[token[ranges(starts[found], sizes[found])]], np.cumsum(sizes[found]) - sizes[found], dtype=np.int64)
            mark[own] = False
            alike = found[common * (over + under) >= over * (sizes[found] + sizes[q])]
            free[alike], labels[alike], left = False, root, left - len(alike)
            queue.extend(alike.tolist())
    return labels


def exact_links(sets: DataFrame, tile: int = 1 << 19) -> DataFrame:
    """Edges (a, b) from rows (label, node, n, hashes): in each label a star for each component of set_links(). hashes are the n distinct values of a set, 8 bytes each.

    A label of more than `tile` values is cut into parts by hash, and each pair of parts meets in a group of its own.
    """
    hot = save(sets.groupBy("label").agg(F.sum("n").alias("n")).where(F.col("n") > tile).select("label", F.ceil(F.col("n") / tile).cast("long").alias("parts")), "hot-labels")
    if hot.isEmpty():
        dealt = sets.withColumn("tile", F.lit(0).cast("long"))
    else:
        part = F.pmod(F.xxhash64("node"), F.col("parts"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
        dealt = sets.join(hot, "label", "left").withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("label", "tile", "node", "hashes").repartition(parts, "label", "tile").sortWithinPartitions("label", "tile")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
            nodes, held = [], []
            for _, _, node, data in group:
                nodes.append(node)
                held.append(np.frombuffer(data, "<u8"))
            labels, nodes = set_links(held), np.array(nodes, np.int64)
            to = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[to]), pa.array(nodes[labels[to]])], names=["a", "b"])

    return dealt.mapInArrow(link, _longs(["a", "b"]))


def copies(docs: DataFrame, shingle: int = 5, wide: int = 4, radius: int = 80, bands: int = 20, rows: int = 4) -> DataFrame:
    """The doc_id of every document but one (the smallest id) of each group of near-duplicates: documents joined by pairs of an exact Jaccard likeness of 0.8 or more of distinct runs of five words.

    Which pairs are compared: those that agree on a band of MinHash and whose fingerprints are within the radius, found by BK-trees, and all that such links join.
    expected_loss() of a pair at 0.8 is 3 in 100,000. The links alone join nothing: exact_links() compares the whole sets. Null ids are never listed.
    """
    names, keys = _names(wide), [f"m{i}" for i in range(bands)]
    longs = ["row", "doc_id", "node", "n", *names, *keys]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, 1):
                out = np.zeros((part.num_rows, 2 + wide + bands), np.uint64)
                for i, text in enumerate(part.column(1)):
                    hashes = np.unique(shingle_hashes(text.as_py(), shingle))
                    out[i, 0], out[i, 1] = xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42), len(hashes)
                    out[i, 2 : 2 + wide], out[i, 2 + wide :] = fingerprint(hashes, wide), band_keys(hashes, bands, rows)
                number = np.arange(task + row, task + row + part.num_rows)
                row += part.num_rows
                columns = [pa.array(np.ascontiguousarray(c)) for c in out.view(np.int64).T]
                yield pa.RecordBatch.from_arrays([pa.array(number), part.column(0), *columns, part.column(1)], names=[*longs, "text"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = [np.unique(shingle_hashes(t.as_py(), shingle)).astype("<u8").tobytes() for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(data, pa.binary())], names=["label", "node", "n", "hashes"])

    schema = StructType([*_longs(longs).fields, StructField("text", StringType())])
    found = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(sketch), schema), "fingerprints")
    nodes = save(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), *[F.max(c).alias(c) for c in ["n", *names, *keys]]), "nodes")
    near = components(band_links(nodes, wide, bands, radius)).join(nodes.select("node", "row"), "node").select("row", "label")
    texts = found.select("row", "node", "n", "text").join(near, "row").select("label", "node", "n", "text")
    sets = save(texts.mapInArrow(tidy(hashed), "label long, node long, n long, hashes binary"), "sets")
    found = _members(found.select("doc_id", "node"), nodes, exact_links(sets))
    return found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
