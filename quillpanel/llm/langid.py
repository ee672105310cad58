"""Language identification with error-correcting output codes: one binary n-gram classifier for each bit of the languages' codewords.

A text's margins for all bits are compared with each codeword; the language whose bits cost the least logistic loss wins, and a narrow win is flagged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import bounded_sample, fold, strings

_LETTER = regex.compile(r"\p{L}")
#: Odd multipliers that spread n-grams over the hashed features.
_SPREAD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def codewords(languages: int, bits: int = 63, seed: int = 42) -> np.ndarray:
    """A row of -1 and 1 for each language: all ways to split up to six languages in two, else random splits, the best of some by the least distance of rows."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        splits = [s for s in itertools.product((-1.0, 1.0), repeat=languages) if s[0] == 1 and -1 in s]
        return np.array(splits).T
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice((-1.0, 1.0), (languages, bits))
        least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        if least > most:
            best, most = code, least
    return best


def ngram_features(texts: list[str], size: int) -> np.ndarray:
    """Square roots of the counts of hashed 1- to 3-grams of characters (lower case, runs of other signs than letters as one space), in rows of length 1."""
    out = np.zeros((len(texts), size), np.float32)
    shift = np.uint32(32 - int(size - 1).bit_length())
    for at in range(0, len(texts), 64):
        part = [f" {t.lower()} " for t in texts[at : at + 64]]
        signs = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(p) for p in part])
        owner = np.repeat(np.arange(len(part)), lengths)
        signs = np.where((signs < 65) | ((signs > 90) & (signs < 97)) | ((signs > 122) & (signs < 170)), np.uint32(32), signs)
        keep = np.concatenate(([True], (signs[1:] != 32) | (signs[:-1] != 32) | (owner[1:] != owner[:-1])))
        signs, owner = signs[keep], owner[keep]
        base = owner * size
        counts = np.zeros(len(part) * size)
        gram = np.zeros(len(signs), np.uint32)
        for n in range(3):
            gram = gram[: len(signs) - n] * np.uint32(31) + signs[n:] * _SPREAD[n]
            same = owner[n:] == owner[: len(owner) - n] if n else slice(None)
            key = base[: len(gram)] + ((gram * _SPREAD[0]) >> shift).astype(np.int64)
            counts += np.bincount(key[same], minlength=len(counts))
        x = np.sqrt(counts.reshape(len(part), size))
        out[at : at + 64] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    size: int

    def losses(self, texts: list[str]) -> np.ndarray:
        """Loss of each language for each text: the logistic losses of its codeword's bits, each weighted by how sure its classifier is."""
        margin = ngram_features(texts, self.size) @ self.weights + self.bias
        sure = np.abs(np.tanh(margin / 2)) + 1e-3
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None, :, :])
        return (loss * sure[:, None, :]).sum(axis=2) / sure.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str], narrow: float = 0.2) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (softmax of the negative losses, summed over bits) and whether the second language is nearly as near."""
        names, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        live = [i for i, t in enumerate(texts) if _LETTER.search(t)] if self.languages else []
        if live:
            loss = self.losses([texts[i] for i in live])
            p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1])
            p /= p.sum(axis=1, keepdims=True)
            best = np.argmin(loss, axis=1)
            order = np.sort(p, axis=1)
            for i, b in zip(live, best.tolist(), strict=True):
                names[i] = self.languages[b]
            scores[live] = order[:, -1]
            unsure[live] = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0) < narrow
        return names, scores, unsure


def fit(labelled: list[tuple[str, str]], size: int = 4096, rounds: int = 150, rate: float = 4.0, penalty: float = 1e-4) -> Model:
    """From (text, language): logistic regressions of all bits at once by accelerated gradient steps; each language weighs the same."""
    labelled = [(t, y) for t, y in labelled if _LETTER.search(t)]
    languages = sorted({y for _, y in labelled})
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((size, 1), np.float32), np.zeros(1), size)
    x = ngram_features([t for t, _ in labelled], size)
    which = np.array([languages.index(y) for _, y in labelled])
    share = (1 / np.bincount(which, minlength=len(languages)) / len(languages))[which][:, None].astype(np.float32)
    target = code[which].astype(np.float32)
    w = np.zeros((size, code.shape[1]), np.float32)
    b, speed_w, speed_b = np.zeros(code.shape[1], np.float32), np.zeros_like(w), np.zeros(code.shape[1], np.float32)
    for _ in range(rounds):
        slope = -target / (1 + np.exp(np.clip(target * (x @ (w + 0.9 * speed_w) + b + 0.9 * speed_b), -30, 30))) * share
        speed_w = 0.9 * speed_w - rate * (x.T @ slope + penalty * w)
        speed_b = 0.9 * speed_b - rate * 0.1 * slope.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return Model(languages, code, w, b, size)


def train(docs: DataFrame, per_language: int = 600, most_bytes: int = 96_000_000) -> Model:
    """Learns from text and non-null lang of documents outside fold 0: of each language about per_language documents, and no more, and so many bytes in all (the documented
    bounds), chosen by hash of the id. An id counts once for each of its languages, however often it is repeated."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("of"), "n")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * per_language)
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(counts), F.col("lang") == F.col("of")).where(draw)
    rows = bounded_sample(sample.select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), "text"), "languages", per_language, most_bytes)
    return fit([(text, lang) for _, text, lang in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out (fold 0), lang_pred, score and ambiguous; columns of these names are replaced. Texts that are null or have no letter are `und`, score 0."""
    new = ["held_out", "lang_pred", "score", "ambiguous"]
    source = docs.select(*[c for c in docs.columns if c not in new]).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    at, shared = source.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                names, scores, unsure = shared.value.predict(strings(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(unsure)], names=[*part.schema.names, *new[1:]])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType([*source.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("ambiguous", BooleanType())
    return source.mapInArrow(run, schema)
