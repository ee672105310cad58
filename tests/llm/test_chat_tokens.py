"""Prefix trees in token ids: read back along ancestors, they are each conversation's own tokens."""

import pytest
from tokenizers import Tokenizer

from quillpanel.llm import chat
from quillpanel.llm.queries import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.mark.parametrize("most", [2, 100])
def test_tokens_along_ancestors(spark, most):
    said = ["hello there", "hi <|endoftext|> ### x: y </turn>", "", "what is 12 × 7?", "it is 84", "über"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", said[(c * t + t * (c > 5)) % 6]) for c in range(12) for t in range(1 + c % 5)] + [(50, 0, "user", said[0]), (50, 1, None, None)]
    packs, members, turns = chat.prefix_forest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), most=most)
    made = {r["pack"]: r for r in chat.token_forest(packs, PATH).collect()}
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    encode = lambda t: library.encode(t, add_special_tokens=False).ids
    leaves = {}
    for r in made.values():
        for n in r["nodes"]:
            assert r["nodes"] and n["position"] == sum(a["end"] - a["begin"] for a in n["ancestors"])
            if n["ends"]:
                parts = [(r["pack"] if a["pack"] == r["pack"] else a["pack"], a["begin"], a["end"]) for a in n["ancestors"]] + [(r["pack"], n["begin"], n["end"])]
                leaves[n["node"]] = [i for p, b, e in parts for i in made[p]["ids"][b:e]]
            if n["mask_end"]:
                assert n["begin"] < n["mask_begin"] < n["mask_end"] < n["end"]
    shown = {r["conv_id"]: r for r in turns.collect()}
    for m in members.collect():
        t, want = shown[m["conv_id"]], []
        for role, text in zip(t["roles"], t["texts"], strict=True):
            whole = chat.format_turn(role, text)
            if role == "assistant" and text:
                _, _, begin, end = chat.parse(whole)[0]
                want += encode(whole[:begin]) + encode(whole[begin:end]) + encode(whole[end:])
            else:
                want += encode(whole)
        assert leaves[m["leaf"]] == want
    assert chat.token_forest(packs.limit(0), PATH).count() == 0
