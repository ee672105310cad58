"""Toxicity by compression distance: windows of words are compressed with a dictionary of toxic and with one of ordinary text, and the lengths compared.

Both dictionaries end in the same ordinary content, so what they share compresses alike; before it the toxic one holds what zstandard's trainer picks from passages of
toxic texts, and the ordinary one as much ordinary text. A label is a whole text's, most of which is ordinary, so passages are taken where a toxic text departs from
ordinary ones, with the words around. A window with toxic words is then shorter by some bytes under the toxic dictionary. The shares of windows by bytes gained go through
thresholds calibrated on labelled texts that the dictionaries have not seen.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import bounded_sample, fold, strings, tidy

#: Bytes gained by a window, from none to this many and more.
GAINS = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def windows(texts: list[list[bytes]], size: int, step: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all the texts, and each window's begin, end and text number. Texts of fewer words are one window, those of none have none."""
    parts, begins, ends, owners, at = [], [], [], [], 0
    for k, words in enumerate(texts):
        if not words:
            continue
        data = b" " + b" ".join(words) + b" "
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        first = np.arange(0, max(1, len(words) - (size - step)), step)
        begins.append(at + gaps[first])
        ends.append(at + gaps[np.minimum(first + size, len(words))] + 1)
        owners.append(np.full(len(first), k))
        parts.append(data)
        at += len(data)
    if not parts:
        return b"", *(np.zeros(0, np.int64) for _ in range(3))
    return b"".join(parts), np.concatenate(begins), np.concatenate(ends), np.concatenate(owners)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """What zstandard's trainer makes of the samples; with too few of them, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[:size]


def _filled(data: bytes, size: int) -> bytes:
    return (data * (size // max(1, len(data)) + 1))[:size] if data else b" " * size


def compressor(content: bytes, level: int = 12) -> zs.ZstdCompressor:
    plain = zs.ZstdCompressionParameters.from_level(level, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=plain)


def lengths(c: zs.ZstdCompressor, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Compressed length of each piece of the data."""
    out = []
    for at in range(0, len(begin), 100_000):
        b, e = begin[at : at + 100_000], end[at : at + 100_000]
        made = c.multi_compress_to_buffer(zs.BufferWithSegments(data, np.stack([b, e - b], axis=1).astype("<u8").tobytes()), threads=0)
        out.append(np.fromiter(map(len, made), np.int64, len(b)))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def word_texts(texts: list[list[bytes]]) -> Counter:
    """In how many of the texts each word is."""
    return Counter(w for t in texts for w in set(t))


def toxic_passages(toxic: list[list[bytes]], ordinary: Counter, count: int, words: int, ratio: float = 10.0, seen: int = 4) -> list[bytes]:
    """Passages of so many words of the toxic texts, all that hold a word which `seen` of these or more (fewer, if there are few) have, and `ratio` times as many, by share, as the `count` ordinary texts, by word_texts()."""
    least, share = min(seen, max(2, len(toxic) // 20)), ratio * max(1, len(toxic)) / max(1, count)
    marked = {w for w, c in word_texts(toxic).items() if c >= least and c > share * (ordinary[w] + 0.5)}
    data, begin, end, _ = windows(toxic, words, 1)
    return [p for b, e in zip(begin.tolist(), end.tolist(), strict=True) if not marked.isdisjoint((p := data[b:e]).split())]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    window: int = 8
    step: int = 4
    level: int = 12

    def features(self, texts: list[str]) -> np.ndarray:
        """Shares of a text's windows that gain at least 1, 2... bytes, the mean and largest gain, the mean loss."""
        if not hasattr(self, "_pair"):
            self._pair = compressor(self.ordinary, self.level), compressor(self.toxic, self.level)
        n = len(texts)
        data, begin, end, owner = windows([words_of(t) for t in texts], self.window, self.step)
        out = np.zeros((n, GAINS + 3))
        if not len(begin):
            return out
        gain = lengths(self._pair[0], data, begin, end) - lengths(self._pair[1], data, begin, end)
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        for k in range(GAINS):
            out[:, k] = np.sqrt(np.bincount(owner, weights=gain > k, minlength=n) / total)
        out[:, GAINS] = np.bincount(owner, weights=np.maximum(gain, 0), minlength=n) / total
        np.maximum.at(out[:, GAINS + 1], owner, np.minimum(gain, 12))
        out[:, GAINS + 2] = np.bincount(owner, weights=np.maximum(-gain, 0), minlength=n) / total
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        z = (self.features(texts) - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights and, last, bias of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: Iterable[tuple[str, int]], toxic_bytes: int = 4096, ordinary_bytes: int = 65_536, passage: int = 2) -> Model:
    """From (text, label). Two thirds, by checksum of the text, make the dictionaries, the rest calibrates; the threshold that splits it best (F1) becomes 0.5."""
    rest: list[tuple[str, int]] = []
    ordinary, toxic_texts, usual, count = [], [], Counter(), 0
    for text, label in labelled:  # ordinary texts are the most, so their words are not held, only passages and counts
        if zlib.crc32(text.encode("utf-8", "surrogatepass")) % 3 == 0:
            rest.append((text, label))
        elif label == 1:
            toxic_texts.append(words_of(text))
        elif label == 0:
            words = words_of(text)
            ordinary += [b" ".join(words[i : i + 12]) + b" " for i in range(0, len(words), 12)]
            usual.update(set(words))
            count += 1
    shared, plain = _filled(_dictionary(ordinary_bytes, ordinary), ordinary_bytes), _filled(_dictionary(toxic_bytes, ordinary[::3]), toxic_bytes)
    del ordinary
    toxic = _filled(_dictionary(toxic_bytes, toxic_passages(toxic_texts, usual, count, passage)), toxic_bytes)
    del toxic_texts, usual
    zero = np.zeros(GAINS + 3)
    model = Model(toxic + shared, plain + shared, zero, zero + 1, zero, 0.0)
    y = np.array([v for _, v in rest], float)
    if not len(y) or y.min() == y.max():
        model.bias = -3.0 if not len(y) or y[0] == 0 else 3.0
        return model
    x = np.concatenate([model.features([t for t, _ in rest[at : at + 200]]) for at in range(0, len(rest), 200)])
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = logistic((x - model.mean) / model.scale, y)
    model.weights, model.bias = w[:-1], float(w[-1])
    z = (x - model.mean) / model.scale @ model.weights + model.bias
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(np.argmax(f1))
    below = z[order[best + 1]] if best + 1 < len(z) else z[order[best]]
    model.bias -= float((z[order[best]] + below) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 3000, ordinary_rows: int = 5000, most_bytes: int = 96_000_000) -> Model:
    """Learns from labelled documents outside fold 0; of each label so many at most, and so many bytes of each (the documented bounds), the first by hash of the id. An id counts once, however often it stands in either table."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & (fold(F.col("id")) != 0)).dropDuplicates(["id"])
    rows = []
    for label, most in ((1, toxic_rows), (0, ordinary_rows)):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        sample = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).where("text is not null")
        rows += bounded_sample(sample.select("id", "label", "text"), f"toxic-{label}", most, most_bytes)
    return fit((text, label) for _, text, label in sorted(rows))


def score(docs: DataFrame, model: Model, held_out: bool = True) -> DataFrame:
    """docs with the columns held_out (fold 0), score and predicted; columns of these names are replaced. Null, empty and white texts have the score of no windows."""
    new = [("held_out", "boolean", pa.bool_()), ("score", "double", pa.float64()), ("predicted", "int", pa.int32())]
    source = docs.select(*[c for c in docs.columns if c not in [n for n, _, _ in new]]).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    at, shared = source.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                found = shared.value.score(strings(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return source.mapInArrow(tidy(run), StructType([*source.schema.fields]).add("score", DoubleType()).add("predicted", IntegerType()))
