"""Fill-in-middle transformation: a text is cut at two token ends and its parts change places, marked so that the text can be read back.

The work runs in Arrow-batched pandas UDFs. A text's token ends stand in one compact array of 32-bit offsets; the two cuts are two look-ups in it.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a word with the white space before it, or white space at the end; the marks of prefix, suffix and middle.
_UNITS = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: str) -> array:
    """0 and the end of each token, in code points; the last one is the text's length."""
    ends = array("I", [0])
    ends.extend(m.end() for m in _UNITS.finditer(text))
    return ends


def draws(doc_id: str | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that depend on the id and the seed only; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(text: str, doc_id: str | None, seed: int = 42, share: int = 50, spm: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle (None if plain) and the output of one text."""
    ends, (h1, h2, h3, h4) = unit_ends(text), draws(doc_id, seed)
    n = len(ends) - 1
    if not text or h3 % 100 >= share or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def read_back(output: str, form: str) -> str:
    """The text that an output was made of. No mark stands inside a part, nor can a part's end and a mark's begin make up a mark, so the first of each kind is the real one."""
    if form == "plain":
        return output
    one, two = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    second = output.index(two, len(one))
    third = output.index(MIDDLE, second + len(two))
    a, b, middle = output[len(one) : second], output[second + len(two) : third], output[third + len(MIDDLE) :]
    return b + middle + a if form == "spm" else a + middle + b


def _sha256(texts: pd.Series) -> list[str]:
    return [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]


MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """docs with n (tokens), form, prefix_chars, middle_chars, output and output_sha256.

    `share` of a hundred texts are changed, `spm` of a hundred of those with the suffix first. Empty and null texts, and those that hold a mark, stay plain; a null
    text counts as empty, a null doc_id as an empty one. Rows that repeat an id draw alike, each by its own text. All columns stay, but those called like a new one
    are replaced. One text at a time is cut, whole; nothing is shuffled.
    """

    @F.pandas_udf(MADE)
    def made(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(t or "", i, seed, share, spm) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        return out.assign(output_sha256=_sha256(out["output"]))

    names = [part.split()[0] for part in MADE.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, made(F.col("doc_id").cast("string"), F.col("text")).alias("_made")).select(*kept, "_made.*")


def restored(output: Column, form: Column) -> Column:
    """text and sha256 (a struct) of the text that an output of fill_in_middle() was made of."""

    @F.pandas_udf("text string, sha256 string")
    def made(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = pd.Series([read_back(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)
        return pd.DataFrame({"text": texts, "sha256": _sha256(texts)})

    return made(output, form)
