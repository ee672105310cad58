"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class after the words before, times its share in the class. Classes are the end of a text, the most frequent words (one each) and,
for all other words, their spelling by their frequency. The class softmax has hashed features: the word before (n-gram), the two classes before (n-gram) and the class
before the last word (skip). What they see of a text is a bounded number of contexts, so one pass over all training texts counts how often each class follows each
context; rounds of gradient updates then go over these counts, whose blocks are dealt to tasks. Counts are whole numbers and gradients are added block by block in one
order, so the weights don't depend on how the texts lie in partitions. Word counts cover the corpus and stay distributed; only the most frequent words are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import fold, most_frequent, save, slices

#: Not in a word, so it is free to name the end of a text.
END = "\n"
_GRAMS = 4096
FEATURES = 3


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, and the number of the text that each is from. Null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = lists.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    there = pc.greater(pc.binary_length(words), 0)  # white space at an end gives an empty word
    return words.filter(there), owner[there.to_numpy(zero_copy_only=False)]


def spelt(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of each word between spaces, as numbers, one after the other, and where each word's begin."""
    padded = pc.binary_join_element_wise(" ", words, " ", "")
    _, offsets, data = padded.buffers()
    ends = np.frombuffer(offsets, np.int32, len(words) + 1).astype(np.int64)
    b = np.frombuffer(data, np.uint8, ends[-1]).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(2246822519)) ^ (b[2:] * np.uint32(3266489917))
    gram = ((mixed * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    inside = np.ones(len(b), bool)
    inside[ends[1:] - 1] = inside[ends[1:] - 2] = False
    return gram[inside[: len(gram)]], ends[:-1] - 2 * np.arange(len(words))


def groups_of_words(near: np.ndarray, weight: np.ndarray, groups: int, starts: int = 8, rounds: int = 15) -> np.ndarray:
    """k-means of words by the directions of their neighbours' counts (rows); of several starts, each of words drawn far from those before, the one whose words lie nearest to their centres."""
    x = np.sqrt(near.astype(np.float32))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weight, rng = weight / weight.sum(), np.random.default_rng(0)
    best, chosen = -1.0, np.zeros(len(x), np.int64)
    for _ in range(starts):
        centre = [x[rng.choice(len(x), p=weight)]]
        far = 1 - x @ centre[0]
        for _ in range(groups - 1):
            p = weight * np.maximum(far, 0)
            centre.append(x[rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else weight)])
            far = np.minimum(far, 1 - x @ centre[-1])
        middle = np.array(centre)
        for _ in range(rounds):
            like = x @ middle.T
            of = np.argmax(like, axis=1)
            for g in range(groups):
                if (of == g).any():
                    middle[g] = (weight[of == g, None] * x[of == g]).sum(axis=0)
            middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
        good = float((weight * like.max(axis=1)).sum())
        if good > best:
            best, chosen = good, of
    return chosen


@dataclass
class Model:
    words: pa.Array  # frequent words, most frequent first
    counts: np.ndarray  # of frequent words
    end_count: int
    singles: int  # so many of them are classes of their own
    named: int  # so many of them are features themselves, others as their class
    bins: int
    groups: int
    spelling: np.ndarray = field(default_factory=lambda: np.zeros((_GRAMS, 1), np.float32))  # log share of each trigram in each group of words
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of frequent words
    log_mass: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of each class's counts, half a count added to each word
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    buckets: int = 1 << 14

    @property
    def size(self) -> int:
        return 1 + self.singles + self.groups * (self.bins + 1)

    @property
    def contexts(self) -> int:
        return (self.size + self.named) * self.size

    def light(self) -> Model:
        """What a round of training needs: no words but those that are features."""
        return replace(self, words=self.words[:0], counts=self.counts[:0], spelling=self.spelling[:0], classes=self.classes[: self.named])

    def rare_class(self, words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int64)
        gram, starts = spelt(words)
        group = np.argmax(np.add.reduceat(self.spelling[gram], starts, axis=0), axis=1)
        return 1 + self.singles + group * (self.bins + 1)

    def settle(self, near: np.ndarray) -> None:
        """Spelling groups from the neighbours of the first words, then the classes of the frequent words: 0 is the end; bins of frequency are powers of eight below the most frequent."""
        n, first = len(self.words), len(near)
        of = groups_of_words(near, np.sqrt(self.counts[:first]), self.groups) if first else np.zeros(0, np.int64)
        total = np.full((_GRAMS, self.groups), 0.05)
        if first:
            gram, starts = spelt(self.words[:first])
            owner = np.repeat(np.arange(first), np.diff(np.append(starts, len(gram))))
            np.add.at(total, (gram, of[owner]), np.sqrt(self.counts[owner]))
        self.spelling = np.log(total / total.sum(axis=0)).astype(np.float32)
        top = np.log(max(1, int(self.counts[self.singles]) if n > self.singles else 1))
        level = np.clip(((top - np.log(np.maximum(self.counts, 1))) / np.log(8)).astype(np.int64), 0, self.bins - 1)
        self.classes = self.rare_class(self.words) + np.where(self.counts > 1, 1 + level, 0)  # what was seen once tells where unseen words stand
        self.classes[: self.singles] = 1 + np.arange(min(n, self.singles))

    def numbered(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of all tokens of the texts, in order: number of the frequent word (-1 rare, -2 end) and text; and the places and words of the rare ones."""
        words, owner = words_of(texts)
        word = self.numbered(words)
        place = np.arange(len(words)) + owner  # each text before has an end
        number, text = np.full(len(words) + len(texts), -2), np.zeros(len(words) + len(texts), np.int64)
        number[place], text[place] = word, owner
        ends = np.flatnonzero(number == -2)
        text[ends] = np.arange(len(texts))
        rare = np.flatnonzero(word < 0)
        return number, text, place[rare], words.take(pa.array(rare))

    def kinds(self, number: np.ndarray, rare: np.ndarray, words: pa.Array) -> np.ndarray:
        kind = np.zeros(len(number), np.int64)
        common = number >= 0
        kind[common] = self.classes[number[common]]
        if len(words):
            met = words.dictionary_encode()
            kind[rare] = self.rare_class(met.dictionary)[met.indices.to_numpy()]
        return kind

    def context(self, number: np.ndarray, kind: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The word (or class) before and the class before that; before a text's first word stands its end."""
        symbol = np.where((number >= 0) & (number < self.named), number + self.size, kind)
        first, second = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        first[1:] = np.where(text[1:] == text[:-1], symbol[:-1], 0)
        second[2:] = np.where(text[2:] == text[:-2], kind[:-2], 0)
        return first * self.size + second

    def before(self, context: np.ndarray) -> np.ndarray:
        """The class of a context's last word."""
        symbol = context // self.size
        known = np.concatenate((np.arange(self.size), self.classes[: self.named], np.zeros(max(0, self.named - len(self.classes)), np.int64)))
        return known[symbol]

    def features(self, context: np.ndarray) -> np.ndarray:
        """Three buckets for each context."""
        second = context % self.size
        keys = np.stack([context // self.size * 4, (self.before(context) * self.size + second) * 4 + 1, second * 4 + 2]).astype(np.uint64)
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (self.buckets.bit_length() - 1))).astype(np.int64)

    def log_classes(self, features: np.ndarray) -> np.ndarray:
        """Logarithms of all classes' probabilities, a row for each context."""
        z = self.bias + self.weights[features[0]]
        for f in features[1:]:
            z += self.weights[f]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all the texts, the end of each counted as a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 16_000_000):
                found = words_of(part.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END])]), pa.concat_arrays([found.field(1), pa.array([part.num_rows], pa.int64())])], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def tally(docs: DataFrame, model: Model, cells: int, keys: Callable[[Model, pa.Array], np.ndarray]) -> DataFrame:
    """(k, n): how often each number below `cells`, which is bounded, comes up among the keys of all the texts. A task adds up before it sends."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros(cells, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                total += np.bincount(keys(model, part.column(0)), minlength=cells)
        found = np.flatnonzero(total)
        for at in range(0, len(found), 100_000):
            k = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    return docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def prepare(train: DataFrame, counts: DataFrame, frequent: int, singles: int, named: int, bins: int, groups: int, placed: int = 4096, near: int = 256) -> Model:
    """The model before training: words, classes and their counts. Spelling groups come from the neighbours that the `placed` most frequent words have among the `near` most frequent, in all texts."""
    words = counts.where(F.col("word") != END)
    top = most_frequent(words, "c", frequent).toArrow().combine_chunks().sort_by([("c", "descending"), ("word", "ascending")])
    end = counts.where(F.col("word") == END).first()
    listed = pa.concat_arrays([pa.array([], pa.string()), *top["word"].cast(pa.string()).chunks])
    model = Model(listed, top["c"].to_numpy(), int(end[1]) if end else 0, singles, named, bins, groups)

    def neighbours(model: Model, texts: pa.Array) -> np.ndarray:
        number, text, _, _ = model.tokens(texts)
        a, b, same = number[:-1], number[1:], text[1:] == text[:-1]
        ahead, behind = same & (a >= 0) & (a < placed) & (b >= 0) & (b < near), same & (b >= 0) & (b < placed) & (a >= 0) & (a < near)
        return np.concatenate((a[ahead] * (2 * near) + b[ahead], b[behind] * (2 * near) + near + a[behind]))

    seen = np.zeros((placed, 2 * near), np.int64)
    found = tally(train, model, seen.size, neighbours).toArrow()
    seen.ravel()[found["k"].to_numpy()] = found["n"].to_numpy()
    del found
    model.settle(seen[: len(listed)])
    del seen
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, mass = shared.value, np.zeros(shared.value.size)
        for batch in batches:
            rare = np.flatnonzero(model.numbered(batch.column(0)) < 0)
            mass += np.bincount(model.rare_class(batch.column(0).take(pa.array(rare))), weights=batch.column(1).to_numpy()[rare] + 0.5, minlength=len(mass))
        yield pa.RecordBatch.from_pydict({"k": np.arange(len(mass)), "m": mass})

    mass = np.zeros(model.size)
    for k, m in words.mapInArrow(masses, "k long, m double").groupBy("k").agg(F.sum("m")).collect():
        mass[k] = m
    mass += np.bincount(model.classes, weights=model.counts + 0.5, minlength=model.size)
    mass[1 + model.singles :: bins + 1] += 0.5  # a word never seen, of each spelling
    mass[0] = model.end_count + 0.5
    model.log_mass = np.log10(np.maximum(mass, 1e-300))
    model.bias = np.log(np.maximum(mass, 1e-3) / mass.sum()).astype(np.float32)
    model.weights = np.zeros((model.buckets, model.size), np.float32)
    return model


def train_weights(train: DataFrame, model: Model, rounds: int, rate: float, prior: float, blocks: int = 16) -> None:
    """Counts (context, class) over all training texts, then rounds of distributed gradient updates over the counts.

    Each task works on blocks of contexts: it adds up, for each feature and class, seen minus expected counts (the gradient) and their mean (its scale). An update is the
    gradient by that scale and the number of features, so that the three together don't step too far; `prior` counts hold rare features back. A block has what follows some classes of words.
    """
    spark, size = train.sparkSession, model.size

    def follows(model: Model, texts: pa.Array) -> np.ndarray:
        number, text, rare, words = model.tokens(texts)
        kind = model.kinds(number, rare, words)
        return model.context(number, kind, text) * model.size + kind

    shared = spark.sparkContext.broadcast(model)

    def with_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = shared.value.before(batch.column(0).to_numpy() // size) % blocks
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "k", "n"])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "k": [rows["k"].to_numpy(np.int64).tobytes()], "n": [rows["n"].to_numpy(np.int64).tobytes()]})

    seen = tally(train, model, model.contexts * size, follows)
    packed = save(seen.mapInArrow(with_block, "block long, k long, n long").groupBy("block").applyInPandas(pack, "block long, k binary, n binary"), "contexts")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model.light())

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = now.value
            for batch in batches:
                for block, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, many = np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)
                    context, row = np.unique(key // size, return_inverse=True)
                    there = np.bincount(row * size + key % size, weights=many, minlength=len(context) * size).reshape(-1, size)
                    features = model.features(context)
                    expected = np.exp(model.log_classes(features).astype(np.float64)) * there.sum(axis=1, keepdims=True)
                    bucket = np.unique(features)
                    sums = np.zeros((2, len(bucket), size))
                    for f in features:
                        order = np.argsort(f, kind="stable")
                        at, first = np.unique(f[order], return_index=True)
                        at = np.searchsorted(bucket, at)
                        sums[0, at] += np.add.reduceat((there - expected)[order], first, axis=0)
                        sums[1, at] += np.add.reduceat((there + expected)[order] / 2, first, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket.tobytes()]), pa.array([sums.astype(np.float32).tobytes()])], names=["block", "bucket", "sums"])

        slope, scale = np.zeros(model.weights.shape), np.full(model.weights.shape, prior)
        for r in sorted(packed.mapInArrow(gradient, "block long, bucket binary, sums binary").collect(), key=lambda r: r["block"]):
            bucket = np.frombuffer(r["bucket"], np.int64)
            sums = np.frombuffer(r["sums"], np.float32).reshape(2, len(bucket), size)
            slope[bucket] += sums[0]
            scale[bucket] += sums[1]
        model.weights += (rate * (slope - prior / FEATURES * model.weights) / scale).astype(np.float32)
        now.destroy()


def score(
    docs: DataFrame, held: int = 1, frequent: int = 131_072, singles: int = 24, named: int = 1024, bins: int = 2, groups: int = 16, rounds: int = 16, rate: float = 0.6, prior: float = 4.0
) -> DataFrame:
    """Per document: doc_id, held_out (crc32(doc_id as text) mod 5 is `held`), n_tokens, n_known, train_tokens, base_score and the model's score, in log10.

    docs needs doc_id and text; other columns are ignored. A null text is empty and has its end only. Repeated rows each give a row. A null id is not held out.
    All other documents train the counts and the weights, in every round. A word that training lacks counts as a word never seen, of its spelling.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)))
    train = docs.where(~F.col("held_out"))
    counts = save(count_words(train), "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = prepare(train, counts, frequent, singles, named, bins, groups)
    train_weights(train, model, rounds, rate, prior)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log10(total + 0.5 * (types + 1)))
    kinds = {"word": pa.string(), "row": pa.int64(), "n": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with what the frequent words say, and one for each rare word of it, to be joined with its count."""
        model = shared.value
        logs = np.append(np.log10(model.counts + 0.5), [np.log10(model.end_count + 0.5), 0.0])  # at -2: end, at -1: rare
        table, ready = np.zeros((model.contexts, model.size), np.float32), np.zeros(model.contexts, bool)
        task, row = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            for part in slices(batch, 1):
                n = part.num_rows
                number, text, rare, words = model.tokens(part.column(1))
                kind = model.kinds(number, rare, words)
                context = model.context(number, kind, text)
                new = np.zeros(model.contexts, bool)
                new[context] = True
                new = np.flatnonzero(new & ~ready)
                for k in range(0, len(new), 4096):
                    table[new[k : k + 4096]] = model.log_classes(model.features(new[k : k + 4096]))
                ready[new] = True
                own = logs[number]
                likely = table[context, kind] / np.log(10) - model.log_mass[kind] + own
                known = (number >= 0) | ((number == -2) & (model.end_count > 0))
                count = lambda w: np.bincount(text, weights=w, minlength=n)
                sums = [count(None).astype(np.int64), count(known).astype(np.int64), count(own - base), count(likely)]
                met = words.dictionary_encode()
                pair, many = np.unique(text[rare] * max(1, len(met.dictionary)) + met.indices.to_numpy(), return_counts=True)
                of, which = np.divmod(pair, max(1, len(met.dictionary)))
                rows = task + row + np.arange(n)
                row += n
                texts = {"word": [f"{END}{i}" for i in rows], "row": rows, "n": np.zeros(n, np.int64), "doc_id": part.column(0), "held_out": part.column(2)}
                yield _rows(kinds, n, texts | dict(zip(("n_tokens", "n_known", "base", "score"), sums, strict=True)))
                yield _rows(kinds, len(of), {"word": met.dictionary.take(pa.array(which)), "row": rows[of], "n": many})

    parts = docs.mapInArrow(run, "word string, row long, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double").join(counts, "word", "left")
    own = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)))
    summed = parts.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(own), F.lit(0.0))).alias("base"),
        (F.max("score") + F.coalesce(F.sum(own), F.lit(0.0))).alias("score"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _rows(kinds: dict[str, pa.DataType], n: int, columns: dict) -> pa.RecordBatch:
    """A batch with all the columns; those not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns and not isinstance(columns[c], pa.Array) else columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))
