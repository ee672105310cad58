"""Chat formatting by prefix trees: conversations that begin with the same turns share them.

Each distinct run of turns from the start is a node. A prefix that many conversations share is a pack of its own; what follows it is cut into packs of bounded size, which
name the packs before them. So each node is emitted once: a pack's nodes stand depth first, each with its place, the position its characters have in any conversation
through it, and the intervals of its ancestors (adjoining ones as one), which are what its characters may attend to besides themselves. The tokens are characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpanel.llm.common import save

#: The template: a turn is the mark, its role, the separator, its text and the end. Inside roles and texts a backslash goes before any of the escaped strings.
MARK, SEPARATOR, ENDING = "### ", ": ", " </turn>\n"
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Reversible: a backslash doubles, and no mark, separator or end of a turn is left whole."""
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>").replace(": ", ":\\ ")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{MARK}{escape(role)}{SEPARATOR}{escape(text)}{ENDING}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and begin and end of the escaped text, of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith(MARK, at), "a turn begins with its mark"
        middle = formatted.index(SEPARATOR, at)
        begin = middle + len(SEPARATOR)
        end = formatted.index(ENDING, begin)
        turns.append((unescape(formatted[at + len(MARK) : middle]), unescape(formatted[begin:end]), begin, end))
        at = end + len(ENDING)
    return turns


def assemble(rows: DataFrame) -> DataFrame:
    """(conv_id, roles, texts, path): turns in order, null roles and texts as empty; path: a key for each run of turns from the start.

    Turns of one number follow by role, then text. One row holds a conversation, which is as long as a training sample.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key, path = b"", []
                for role, text in zip(roles, texts, strict=True):
                    key = hashlib.sha256(b"\0".join((key, role.encode("utf-8", "surrogatepass"), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()))).digest()[:16]
                    path.append(key.hex())
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.string()))], names=["conv_id", "roles", "texts", "path"])

    turns = turns.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    return turns.mapInArrow(keyed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, roles array<string>, texts array<string>, path array<string>")


def pack_keys(turns: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, pack, skip) for each distinct conversation, by the key of its last turn; and (node, depth, leaf) of the hot prefixes, with some conversation through each.

    A prefix that over `most` distinct conversations share is hot and a pack of its own. `skip` turns of a conversation are hot; below them its next turn's key, dealt to
    as many buckets as the last hot prefix needs, names the pack; without a hot prefix it is the first turn's key, likewise. So packs hold about `most` conversations
    each, and conversations with the same next turn meet in one. Hot prefixes are broadcast while they are counted to be few.
    """
    leaves = turns.select(F.element_at("path", -1).alias("leaf"), "path").dropDuplicates(["leaf"])
    steps = leaves.select("leaf", F.posexplode("path").alias("depth", "node"))
    nodes = steps.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("leaf").alias("through"))
    hot = save(nodes.where(F.col("n") > most).select("node", "depth", "through", F.ceil(F.col("n") / most).alias("parts")), "hot-prefixes")
    known = hot.select("node", "parts")
    last = steps.join(F.broadcast(known) if hot.count() <= 100_000 else known, "node").groupBy("leaf").agg(F.max(F.struct("depth", "node", "parts")).alias("hot"))
    buckets = -(-leaves.count() // most) or 1
    after = F.get("path", F.col("hot.depth") + 1)
    bucket = F.pmod(F.xxhash64(after), F.col("hot.parts"))
    first = F.concat(F.lit("/"), F.pmod(F.xxhash64(F.get("path", F.lit(0))), F.lit(buckets)).cast("string"))
    key = F.when(F.col("hot").isNull(), first).when(after.isNull(), F.col("hot.node")).otherwise(F.concat_ws("/", F.col("hot.node"), bucket.cast("string")))
    return leaves.join(last, "leaf", "left").select("leaf", key.alias("pack"), F.coalesce(F.col("hot.depth") + 1, F.lit(0)).alias("skip")), hot.select("node", "depth", F.col("through").alias("leaf"))


def _longer(intervals: list[dict], pack: str, begin: int, end: int) -> list[dict]:
    if intervals and intervals[-1]["pack"] == pack and intervals[-1]["end"] == begin:
        return [*intervals[:-1], {**intervals[-1], "end": end}]
    return [*intervals, {"pack": pack, "begin": begin, "end": end}]


def _emit(pack: str, skip: int, group: list[tuple[list[str], list[str], list[str]]], leaves: set[str]) -> tuple[str, list[dict]]:
    """A pack's text and its nodes, depth first. group: path, roles and texts of distinct conversations, of which the first `skip` turns lie in packs named by their keys."""
    at, parts, nodes, open_nodes = 0, [], [], []
    base, above = 0, []
    for key, role, text in zip(*(x[:skip] for x in group[0]), strict=True) if group else ():
        length = len(format_turn(role, text))
        above, base = _longer(above, key, 0, length), base + length
    for path, roles, texts in sorted(group, key=lambda g: g[0]):
        shared = 0
        while shared < min(len(open_nodes), len(path) - skip) and open_nodes[shared]["node"] == path[skip + shared]:
            shared += 1
        del open_nodes[shared:]
        for depth in range(skip + shared, len(path)):
            text, parent = format_turn(roles[depth], texts[depth]), open_nodes[-1] if open_nodes else None
            node = {"node": path[depth], "depth": depth, "role": roles[depth], "begin": at, "end": at + len(text), "ends": path[depth] in leaves}
            node["position"] = parent["position"] + parent["end"] - parent["begin"] if parent else base
            node["ancestors"] = _longer(parent["ancestors"], pack, parent["begin"], parent["end"]) if parent else above
            begin, end = parse(text)[0][2:] if roles[depth] == "assistant" else (0, 0)
            node["mask_begin"], node["mask_end"] = (at + begin, at + end) if begin else (0, 0)
            nodes.append(node)
            open_nodes.append(node)
            parts.append(text)
            at += len(text)
    return "".join(parts), nodes


NODE = "node string, depth int, role string, begin long, end long, position long, ancestors array<struct<pack: string, begin: long, end: long>>, mask_begin long, mask_end long, ends boolean"


def prefix_forest(rows: DataFrame, most: int = 128) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packs (pack, shared, trunk, text, nodes), and members (conv_id, leaf, pack), and turns as assembled.

    trunk: the packs, in order, that hold the turns before a pack's own; shared: whether the pack is such a prefix. nodes: each node's place [begin, end) in the pack's
    text, the position of its first character (its own conversations', counted from their start), its ancestors' places, the characters that a loss counts (0, 0 but
    for assistants), and whether a conversation ends there. rows needs conv_id, turn, role and text; others are ignored. A null conv_id is a conversation of its own.
    Repeated conversations are members of one leaf. An empty table gives no packs.
    """
    turns = save(assemble(rows.select("conv_id", "turn", "role", "text")), "turns")
    keys, hot = pack_keys(turns, most)
    keys = save(keys, "packs")
    members = turns.select("conv_id", F.element_at("path", -1).alias("leaf")).join(keys.select("leaf", "pack"), "leaf")
    distinct = turns.select(F.element_at("path", -1).alias("leaf"), "path", "roles", "texts").dropDuplicates(["leaf"])
    below = distinct.join(keys, "leaf").where(F.size("path") > F.col("skip")).select("pack", "skip", F.lit(False).alias("shared"), F.lit(True).alias("ends"), "path", "roles", "texts")
    ended = keys.where("pack NOT LIKE '%/%'").select(F.col("leaf").alias("node"), F.lit(True).alias("ends"))
    cut = lambda c: F.slice(c, F.lit(1), F.col("depth") + 1).alias(c)
    trunk = hot.join(distinct, "leaf").join(ended, "node", "left").select(F.col("node").alias("pack"), F.col("depth").alias("skip"), F.lit(True).alias("shared"), F.coalesce("ends", F.lit(False)).alias("ends"), *map(cut, ("path", "roles", "texts")))
    fields = ", ".join(f.replace(" ", ": ", 1) for f in re.split(r", (?![^<]*>)", NODE))

    def emit(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        pack, skip = first["pack"], int(first["skip"])
        lists = [tuple(map(list, x)) for x in zip(group["path"], group["roles"], group["texts"], strict=True)]
        text, nodes = _emit(pack, skip, lists, {path[-1] for path, _, _ in lists} if first["ends"] else set())
        return pd.DataFrame({"pack": [pack], "shared": [first["shared"]], "trunk": [lists[0][0][:skip]], "text": [text], "nodes": [nodes]})

    packs = below.unionByName(trunk).groupBy("pack").applyInPandas(emit, f"pack string, shared boolean, trunk array<string>, text string, nodes array<struct<{fields}>>")
    return save(packs, "forest"), members, turns


def read_back(packs: DataFrame, members: DataFrame) -> DataFrame:
    """What each conversation says, from the packs' texts, intervals and masks alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    trunk = packs.where("shared").select(F.col("pack").alias("from"), F.struct(F.col("pack").alias("key"), "text", F.col("nodes")[0]["mask_begin"].alias("begin"), F.col("nodes")[0]["mask_end"].alias("end")).alias("t"))
    before = packs.select("pack", F.explode("trunk").alias("from")).join(trunk, "from").groupBy("pack").agg(F.collect_list("t").alias("before"))
    used = packs.select("pack", "text", F.filter("nodes", lambda n: n["ends"]).alias("ends"), F.filter("nodes", lambda n: n["mask_begin"] > 0).alias("said"))
    used = used.where(F.size("ends") > 0).select("pack", "text", "ends", F.transform("said", lambda n: n["mask_begin"]).alias("begins"), F.transform("said", lambda n: n["mask_end"]).alias("stops"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            for pack, own, nodes, begins, stops, before in zip(*(batch[c] for c in batch.columns), strict=True):
                held = {pack: (own, list(begins), list(stops))}
                for t in before if before is not None else ():
                    held[t["key"]] = t["text"], [t["begin"]] * bool(t["begin"]), [t["end"]] * bool(t["begin"])
                out = []
                for n in nodes:
                    formatted, said = [], []
                    for x in [*n["ancestors"], {"pack": pack, "begin": n["begin"], "end": n["end"]}]:
                        text, begin, end = held[x["pack"]]
                        formatted.append(text[x["begin"] : x["end"]])
                        said += [text[begin[i] : end[i]] for i in range(bisect_left(begin, x["begin"]), bisect_left(begin, x["end"]))]
                    formatted, said = "".join(formatted), "".join(map(unescape, said))
                    turns = parse(formatted)
                    assert n["position"] + n["end"] - n["begin"] == len(formatted), "positions count a conversation's characters"
                    out.append((pack, n["node"], len(turns), sha("".join(f"{role}\n{words}\n" for role, words, _, _ in turns)), len(said), sha(said), len(formatted)))
                yield pd.DataFrame(out, columns=["pack", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    seen = used.join(before, "pack", "left").mapInPandas(walk, "pack string, leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return members.join(seen, ["pack", "leaf"]).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def token_forest(packs: DataFrame, path: str) -> DataFrame:
    """The packs in token ids of a byte-level vocabulary of the tokenizers library (a .json file): pack, shared, trunk, ids, and nodes with all places counted in tokens.

    A node is encoded by itself, and its loss text by itself within it, so shared turns have the same ids in every conversation, and intervals and masks end between tokens. A
    node's position counts the tokens of its ancestors. The template's strings and those of special tokens are ordinary text. Packs without nodes stay as they are.
    """
    trunk = packs.where("shared").select(F.col("pack").alias("from"), F.struct(F.col("pack").alias("key"), "text", F.col("nodes")[0]["mask_begin"].alias("begin"), F.col("nodes")[0]["mask_end"].alias("end")).alias("t"))
    before = packs.select("pack", F.explode("trunk").alias("from")).join(trunk, "from").groupBy("pack").agg(F.collect_list("t").alias("before"))
    held: dict = {}  # the tokenizer of a worker

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        if path not in held:
            held[path] = Tokenizer.from_file(path)
            held[path].encode_special_tokens = True

        def pieces(text: str, begin: int, end: int, mask_begin: int, mask_end: int) -> list[list[int]]:
            cuts = [begin, mask_begin, mask_end, end] if mask_end > mask_begin else [begin, end]
            return [e.ids for e in held[path].encode_batch([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], add_special_tokens=False)]

        for batch in batches:
            out = []
            for pack, shared, above, text, nodes, first in zip(*(batch[c] for c in ("pack", "shared", "trunk", "text", "nodes", "before")), strict=True):
                sizes = {t["key"]: sum(map(len, pieces(t["text"], 0, len(t["text"]), t["begin"], t["end"]))) for t in (first if first is not None else ())}
                ids, made, at = [], [], {0: 0}  # at: the token that each node's end in characters falls on
                for n in nodes:
                    parts = pieces(text, n["begin"], n["end"], n["mask_begin"], n["mask_end"])
                    begin = len(ids)
                    ids += [i for p in parts for i in p]
                    at[n["end"]] = len(ids)
                    ancestors = [{"pack": a["pack"], "begin": at[a["begin"]], "end": at[a["end"]]} if a["pack"] == pack else {"pack": a["pack"], "begin": 0, "end": sizes[a["pack"]]} for a in n["ancestors"]]
                    mask = (begin + len(parts[0]), begin + len(parts[0]) + len(parts[1])) if len(parts) == 3 else (0, 0)
                    made.append({"node": n["node"], "depth": n["depth"], "role": n["role"], "begin": begin, "end": len(ids), "position": sum(a["end"] - a["begin"] for a in ancestors), "ancestors": ancestors, "mask_begin": mask[0], "mask_end": mask[1], "ends": n["ends"]})
                out.append((pack, shared, list(above), ids, made))
            yield pd.DataFrame(out, columns=["pack", "shared", "trunk", "ids", "nodes"])

    kind = packs.schema["nodes"].dataType.simpleString()
    rows = packs.join(before, "pack", "left").select("pack", "shared", "trunk", "text", "nodes", "before")
    return rows.mapInPandas(walk, f"pack string, shared boolean, trunk array<string>, ids array<int>, nodes {kind}")
