"""BPE encoding and decoding: a minimal acyclic transducer holds the frequent words with their ids; other words are merged exactly.

The transducer shares suffixes (incremental minimisation over sorted words). Each state knows how many words end below it, so a walk sums up the word's number,
and that number points to its ids. Its arrays lie in one file that each Python worker maps into memory.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import most_frequent, save, slices, strings, tidy

#: Fixed values of the vocabulary's pre-tokenizer: contractions, runs of letters, single digits, runs of other signs.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Python's str methods take these for white space, the vocabulary's patterns don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself where Latin-1 prints it, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in signs:
            signs[b], spare = chr(spare), spare + 1
    return [signs[b] for b in range(256)]


class Vocabulary:
    """A word-level BPE file of the tokenizers library: lower case, white space dropped, words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: A pair of ids, as one number, to its rank and its id, as one number.
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank << 32 | self.ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        signs = byte_signs()
        self.inner = [self.ids.get(s, -1) for s in signs]
        self.final = [self.ids.get(s + self.suffix, -1) for s in signs]
        #: The same tables as arrays, for merge_all().
        order = sorted(self.ranks) or [-1]
        self.pairs, self.pair_ranks = np.array(order, np.int64), np.array([self.ranks.get(k, 1 << 62) for k in order], np.int64)
        self.starts = np.array(self.inner + self.final, np.int64)
        self.first_ranks = self._ranks_of(np.repeat(self.starts, 512), np.tile(self.starts, 512))
        size = max(self.names) + 1
        self.printed = pa.array([str(i) for i in range(size)], pa.string())
        self.tokens = pa.array([self.names.get(i, "") for i in range(size)], pa.string())

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space, which no word crosses; a special token stands after a space, which no other chunk holds."""
        if self.split is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [f" {part}"] if i % 2 else self._plain(part)
        return out

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a final sigma is lower-cased like any other
        if not _SEPARATORS.search(text):
            return text.lower().split()
        return [c for c in regex.split(r"\p{White_Space}+", text.lower()) if c]  # str.split would drop the separators

    @staticmethod
    def words(chunk: str) -> list[str]:
        return [chunk] if chunk.isalpha() else _PIECES.findall(chunk)

    def merge(self, word: str) -> tuple[int, ...]:
        """Exact BPE of one word, of any length: the pair of the lowest rank, leftmost first, until no pair merges. A heap holds the pairs, links the neighbours."""
        data = word.encode("utf-8", "replace")
        ids = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        after, before, rank = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.ranks.get
        heap = [(r, i) for i, (a, b) in enumerate(itertools.pairwise(ids)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            best, at = heapq.heappop(heap)
            right = after[at]
            if right < 0 or ids[at] < 0 or rank(ids[at] << 32 | ids[right]) != best:
                continue  # one of the two has merged since
            ids[at], ids[right] = best & 0xFFFFFFFF, -1
            after[at] = far = after[right]
            if far >= 0:
                before[far] = at
                if (r := rank(ids[at] << 32 | ids[far])) is not None:
                    heapq.heappush(heap, (r, at))
            if (left := before[at]) >= 0 and (r := rank(ids[left] << 32 | ids[at])) is not None:
                heapq.heappush(heap, (r, left))
        return tuple(i for i in ids if i >= 0)

    def merge_all(self, words: list[bytes], long: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words at once: all ids, and how many each word has. Words of more than `long` bytes are merged one by one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        alone = {w: self.merge(words[w].decode()) for w in np.flatnonzero(sizes > long).tolist()}
        owners = [np.full(len(ids), w) for w, ids in alone.items()]
        merged = [np.array(ids, np.int64) for ids in alone.values()]
        short = np.flatnonzero((sizes > 0) & (sizes <= long))
        data = np.frombuffer(b"".join([words[w] for w in short.tolist()]), np.uint8).astype(np.int64)
        owner = np.repeat(short, sizes[short])
        last = np.ones(len(data), bool)
        last[:-1] = owner[1:] != owner[:-1]
        data[last] += 256
        ids, none = self.starts[data], 1 << 62
        rank = np.full(len(data), none)
        inner = np.flatnonzero(~last)
        rank[inner] = self.first_ranks[data[inner] * 512 + data[inner + 1]]
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            spans = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            more = best < none
            live = np.repeat(more, spans)
            owners.append(owner[~live])
            merged.append(ids[~live])
            at = np.flatnonzero(live & (rank == np.repeat(best, spans)))
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))] if len(at) else at
            ids[at] = rank[at] & 0xFFFFFFFF
            rank[at] = rank[at + 1] if len(at) else rank[at]
            live[at + 1] = False
            changed = np.zeros(len(ids), bool)
            changed[at] = True
            ids, owner, rank, changed = ids[live], owner[live], rank[live], changed[live]
            for i in (np.flatnonzero(changed), np.flatnonzero(changed[1:])):  # the pairs that begin and that end with a new id
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self._ranks_of(ids[i], ids[i + 1])
        owner, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (owners, merged))
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], 1 << 62)

    def decode(self, ids: Iterable[int]) -> str:
        """Without a decoder the library joins the tokens by spaces."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_lexicon(entries: dict[bytes, tuple[int, ...]]) -> bytes:
    """The transducer of a lexicon as one block of bytes. States are numbered so that equal suffixes share states."""
    registry: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the last word: final, edges

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            key = (final, tuple(edges))
            if key not in registry:
                registry[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], registry[key])

    words = sorted(entries)
    last = b""
    for word in words:
        shared = len(os.path.commonprefix([word, last]))
        close(shared)
        for b in word[shared:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for s, (final, edges) in enumerate(states):  # the states below come first
        count = int(final)
        for b, t in edges:
            keys.append(s * 256 + b)
            targets.append(t)
            skips.append(count)
            count += int(below[t])
        below[s] = count
    offsets = np.concatenate(([0], np.cumsum([len(entries[w]) for w in words]))) if words else np.zeros(1)
    arrays = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([f for f, _ in states], np.int8), offsets.astype(np.int32), np.array([i for w in words for i in entries[w]], np.int32)]
    head = struct.pack("<7q", root, *(len(a) for a in arrays))
    return head + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled transducer, memory-mapped."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(data), access=mmap.ACCESS_READ)
        self.root, *lengths = struct.unpack_from("<7q", self.map)
        at, arrays = 56, []
        for n, kind in zip(lengths, (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32), strict=True):
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = arrays

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the lexicon, -1 where it has none; all words walk together, byte by byte."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text, starts = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(lengths)[:-1]))
        live = np.flatnonzero(lengths > 0)
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = state[live] * 256 + text[starts[live] + step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            live, edge = live[there], edge[there]
            number[live] += self.skips[edge]
            state[live] = self.targets[edge]
            step += 1
            done = lengths[live] == step
            ended = live[done]
            ended = ended[self.final[state[ended]] == 1]
            out[ended] = number[ended]
            live = live[~done]
        return out


class Encoder:
    """Texts to ids, with a bounded cache of the chunks that this worker has met: a chunk's number, and the place of its ids in one array."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None, cached: int = 300_000):
        self.vocab, self.lexicon, self.cached = vocab, lexicon, cached
        self.forget()

    def forget(self) -> None:
        special = list(self.vocab.special.values())
        self.known = {f" {t}": n for n, t in enumerate(self.vocab.special)}
        self.begins, self.sizes, self.ids = np.arange(len(special)), np.ones(len(special), np.int64), np.array(special, np.int32)

    def learn(self, new: list[str]) -> None:
        parts = [self.vocab.words(c) for c in new]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        numbered = {w: n for n, w in enumerate(words)}
        data = [w.encode("utf-8", "replace") for w in words]
        number = self.lexicon.numbers(data) if self.lexicon else np.full(len(words), -1)
        other = np.flatnonzero(number < 0)
        ids, sizes = self.vocab.merge_all([data[i] for i in other.tolist()])
        held, begins, lengths = ids, np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begins[other], lengths[other] = np.cumsum(sizes) - sizes, sizes
        if self.lexicon:
            common = np.flatnonzero(number >= 0)
            begins[common] = self.lexicon.offsets[number[common]] + len(ids)
            lengths[common] = self.lexicon.offsets[number[common] + 1] - self.lexicon.offsets[number[common]]
            held = np.concatenate((ids, self.lexicon.ids))
        each = np.fromiter(map(numbered.__getitem__, chain.from_iterable(parts)), np.int64)
        made = held[_ranges(begins[each], lengths[each])].astype(np.int32)
        owner = np.repeat(np.arange(len(new)), np.fromiter(map(len, parts), np.int64, len(parts)))
        sizes = np.bincount(owner, weights=lengths[each], minlength=len(new)).astype(np.int64)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.begins = np.concatenate((self.begins, np.cumsum(sizes) - sizes + len(self.ids)))
        self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, made))

    def numbers(self, chunks: list[str]) -> np.ndarray:
        met = pa.array(chunks, pa.string()).dictionary_encode()
        names = met.dictionary.to_pylist()
        new = [c for c in names if c not in self.known]
        if len(self.known) + len(new) > self.cached:
            self.forget()
            new = [c for c in names if c not in self.known]
        if new:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[met.indices.to_numpy()]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the place at which each text begins (one more: the end). The automaton walks over the new words of all of them at once."""
        chunked = [self.vocab.chunks(t) for t in texts]
        number = self.numbers(list(chain.from_iterable(chunked)))
        sizes = self.sizes[number]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum([len(c) for c in chunked])))]
        return self.ids[_ranges(self.begins[number], sizes)], ends.astype(np.int32)

    @staticmethod
    def joined(ids: np.ndarray, ends: np.ndarray, names: pa.Array) -> pa.Array:
        """Each text's names of its ids, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(ids))), " ")


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each begin on, so many as its length says, one after the other."""
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def frequent_words(docs: DataFrame, path: str, size: int, held: int = 600_000) -> list[str]:
    """The most frequent words of all the texts (ties by the word), `size` at most: what the lexicon holds; all others are merged. A task counts about `held` chunks at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, chunks = vocabulary(path), []

        def out() -> pa.RecordBatch:
            words: Counter = Counter()
            found = pa.array(chunks, pa.string()).value_counts()
            for chunk, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                for w in vocab.words(chunk):
                    words[w] += n
            chunks.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(words.keys(), pa.string()), "n": pa.array(words.values(), pa.int64())})

        for batch in batches:
            for text in strings(batch.column(0)):
                found = vocab.chunks(text)
                chunks += [c for c in found if c[0] != " "] if "<|" in text else found
                if len(chunks) > held:
                    yield out()
        yield out()

    counts = save(docs.select("text").mapInArrow(tidy(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "bpe-words")
    return [r[0] for r in most_frequent(counts, "n", size).collect()]


def build_lexicon(docs: DataFrame, path: str, size: int = 65_536) -> bytes:
    vocab = vocabulary(path)
    return compile_lexicon({w.encode(): vocab.merge(w) for w in frequent_words(docs, path, size)})


_workers: dict[str, tuple[bytes, Encoder]] = {}


def _encoder(path: str, lexicon: bytes) -> Encoder:
    """One for each Python worker, kept between its tasks."""
    if path not in _workers or _workers[path][0] != lexicon[:4096] + lexicon[-4096:]:
        _workers[path] = lexicon[:4096] + lexicon[-4096:], Encoder(vocabulary(path), Lexicon(lexicon))
    return _workers[path][1]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", lexicon_size: int = 65_536) -> DataFrame:
    """docs with an array column of token ids, and the text's own decoding in `<ids>_decoded`.

    Null and empty texts have no ids and decode to an empty string. Columns called like the new ones are replaced; all others stay, whatever their names.
    Special tokens inside a text become their ids, as the library does by default.
    """
    source = docs.select(*[c for c in docs.columns if c not in (ids, f"{ids}_decoded")])
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs.select(F.col(text).alias("text")), path, lexicon_size))
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        for batch in batches:
            for part in slices(batch, at, 2_000_000):
                found, ends = encoder.encode_all(strings(part.column(at)))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(found)), encoder.joined(found, ends, encoder.vocab.tokens)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids, f"{ids}_decoded"])

    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    schema = StructType([*source.schema.fields]).add(ids, ArrayType(IntegerType())).add(f"{ids}_decoded", StringType())
    return source.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, path: str, lexicon_size: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document's ids and of what they decode to."""
    import hashlib

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, lexicon_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, shared.value)
        digest = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()], pa.string())
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                ids, ends = encoder.encode_all(strings(part.column(1)))
                columns = [part.column(0), pa.array(np.diff(ends).astype(np.int64)), *(digest(encoder.joined(ids, ends, n)) for n in (encoder.vocab.printed, encoder.vocab.tokens))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(ids: Column, path: str) -> Column:
    """The text of an array column of ids, as the library decodes them."""
    import pandas as pd

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return column.map(lambda x: "" if x is None else vocab.decode(x))

    return text_of(ids)
