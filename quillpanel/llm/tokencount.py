"""Token counts by the whole-token shortcut.

Two things are proven from the vocabulary alone, before any text is read: where no token can reach across (so a text falls into pre-tokens whose counts just add up),
and which vocabulary strings encode alone as one token. Pre-tokens among the latter count as one; only the rest is merged, each distinct one once.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the sign that stands for a space in pieces.
SPACE = "▁"


class Pieces:
    """A BPE model of the sentencepiece library with byte fallback, whose normalizer only adds a space in front and writes spaces as a sign. Other kinds raise ValueError."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, trained, kinds = spec.normalizer_spec, spec.trainer_spec, type(spec.pieces[0])
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("only models whose normalizer adds a leading space and changes nothing else")
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces")
        self.scores: dict[str, float] = {p.piece: p.score for p in spec.pieces if p.type == kinds.NORMAL}
        self.pattern = pre_token_pattern(self.scores)
        self.whole = frozenset(p for p in self.scores if self.count(p) == 1)

    def count(self, pre_token: str) -> int:
        """Tokens of a string by exact BPE: the pair of the highest score, leftmost first, until no pair makes a piece. A sign that is no piece counts its bytes."""
        parts, score = list(pre_token), self.scores.get
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(itertools.pairwise(parts)) if (s := score(a + b)) is not None]
        heapq.heapify(heap)
        left = len(parts)
        while heap:
            _, at, made = heapq.heappop(heap)
            right = after[at]
            if right < 0 or not parts[at] or parts[at] + parts[right] != made:
                continue  # one of the two has merged since
            parts[at], parts[right] = made, ""
            left -= 1
            after[at] = far = after[right]
            if far >= 0:
                before[far] = at
                if (s := score(made + parts[far])) is not None:
                    heapq.heappush(heap, (-s, at, made + parts[far]))
            if (near := before[at]) >= 0 and (s := score(parts[near] + made)) is not None:
                heapq.heappush(heap, (-s, near, parts[near] + made))
        return left + sum(len(p.encode("utf-8", "replace")) - 1 for p in parts if len(p) == 1 and p not in self.scores)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []


def pre_token_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Cuts between signs that never stand side by side in a piece: no token holds both, and merges on either side don't meet.

    Signs (but for the space) that do stand side by side are joined to classes; a class with itself is not cut. The space sign must never follow another sign in a
    piece, which is checked; then a cut may stand before every run of spaces.
    """
    root: dict[str, str] = {}
    beside: set[str] = set()  # signs that have another sign, or themselves, at their side in a piece

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    for piece in pieces:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError("a piece goes on after a space")
        signs = piece.lstrip(SPACE)
        for c in signs:
            root[find(signs[0])] = find(c)
        if len(signs) > 1:
            beside.update(signs)
    classes = defaultdict(list)
    for c in sorted(root):
        classes[find(c)].append(c)
    joined = sorted((c for c in classes.values() if c[0] in beside), key=len, reverse=True)
    alone = [c for c in sorted(root) if c not in beside]
    charset = lambda signs: "[" + "".join(map(re.escape, signs)) + "]"
    ways = [f"{charset(c)}++" for c in joined] + ([f"{charset(alone)}"] if alone else [])
    return re.compile(f"{SPACE}*+(?:{'|'.join(ways)})|{SPACE}++|[^{SPACE}]" if ways else f"{SPACE}++|[^{SPACE}]")


class Counts:
    """Tokens of texts, with a bounded cache of merged pre-tokens."""

    def __init__(self, pieces: Pieces, cached: int = 300_000):
        self.pieces, self.cached, self.merged = pieces, cached, {}

    def of(self, texts: list[str], size: int = 1_000_000) -> list[int]:
        """Texts are taken together until they have `size` characters, a longer one alone."""
        out: list[int] = []
        held: list[list[str]] = []
        room = size
        for text in texts:
            held.append(self.pieces.split(text))
            room -= len(text)
            if room <= 0:
                out += self._sums(held)
                held, room = [], size
        return out + self._sums(held)

    def _sums(self, held: list[list[str]]) -> list[int]:
        met = pa.array(itertools.chain.from_iterable(held), pa.string()).dictionary_encode()
        whole, merged = self.pieces.whole, self.merged
        if len(merged) > self.cached:
            merged.clear()
        each = np.empty(len(met.dictionary), np.int64)
        for i, t in enumerate(met.dictionary.to_pylist()):
            if t in whole:
                each[i] = 1
            else:
                if t not in merged:
                    merged[t] = self.pieces.count(t)
                each[i] = merged[t]
        sums = np.concatenate(([0], np.cumsum(each[met.indices.to_numpy()])))
        return np.diff(sums[np.concatenate(([0], np.cumsum([len(h) for h in held])))]).tolist() if held else []


_workers: dict[str, Counts] = {}


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column as the library's encode() gives them, without begin, end or added tokens; special strings inside a text are ordinary text. Null counts 0.

    The model's file is read by each Python worker once, where its proofs are made anew (about a second)."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        if path not in _workers:
            _workers[path] = Counts(Pieces(path))
        return pa.array(_workers[path].of([t or "" for t in texts.to_pylist()]), pa.int64())

    return counted(text)


def with_counts(docs: DataFrame, path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens above `limit`).

    Null and empty texts have no bytes and no tokens. All rows and columns stay, repeated ones too; columns called like the new ones are replaced. Nothing is shuffled,
    and a batch of texts is counted about a million characters at a time, so a task holds the pre-tokens of that much and of the longest text.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")])
    found = kept.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", token_count(F.col(text), path))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
