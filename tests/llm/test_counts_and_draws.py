"""Token counts, importance resampling and fill-in-middle against the library, brute force and round trips, and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece

from quillpanel.llm import importance, infill, tokencount
from quillpanel.llm.queries import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (5, "same text of some words here"), (6, "same text of some words here"), (6, "same text of some words here"), (None, "no id here"), (7, "long " * 30_000), (8, "a <P> b"), (9, "<s> ▁▁  ── ½² \x00 é中文😀</s>"), (10, "Wörter ÄÖ aB1 c-d")]
DOCS = "doc_id long, text string, n_tokens string, form string, rank string, weight string, n string, block long, part int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", 1, 2) for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


# token counts


def test_every_piece_that_is_called_whole_encodes_alone(library):
    pieces = tokencount.Pieces(PATH)
    assert len(pieces.whole) > 25_000
    plain = [p for p in pieces.whole if p.startswith("▁") and "▁" not in p[1:]]  # the library adds the first space itself
    assert all(len(ids) == 1 for ids in library.encode([p[1:] for p in plain if p != "▁"]))


def test_pre_tokens_never_cut_a_token(library):
    pieces, rng = tokencount.Pieces(PATH), random.Random(3)
    signs, parts = "abcXYZ  ▁▁\n\t\r.,;'\"²³½¼éñßжщдЖ中文日あア한​́😀<s></s>\x00�0189{}()->=!─═", sorted(pieces.scores)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(6))).replace("▁", " ") for _ in range(4000)]
    for text, tokens in zip(texts, library.encode(texts, out_type=str), strict=True):
        ends, at = set(), 0
        for t in tokens:
            at += 1 if re.fullmatch("<0x[0-9A-F]{2}>", t) else len(t.encode())
            ends.add(at)
        at = 0
        for t in pieces.split(text):
            at += len(t.encode())
            assert at in ends, (text, tokens)
    assert tokencount.Counts(pieces, cached=50).of(texts, size=200) == [len(ids) for ids in library.encode(texts)]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        tokencount.Pieces(str(tmp_path / "m.model"))
    with pytest.raises(ValueError):
        tokencount.pre_token_pattern(["a▁b"])


def test_token_counts(spark, sf, edge, nothing, library):
    found = tokencount.with_counts(edge, PATH, limit=5)
    assert set(found.columns) == {*edge.columns, "n_bytes", "over_limit"} and dict(found.dtypes)["n_tokens"] == "bigint"
    rows = found.select("doc_id", "text", "n_bytes", "n_tokens", "over_limit").collect()
    assert sorted(map(str, rows)) == sorted(str(type(rows[0])(doc_id=i, text=t, n_bytes=len((t or "").encode()), n_tokens=(n := len(library.encode(t or ""))), over_limit=n > 5)) for i, t in EDGE)
    assert tokencount.with_counts(nothing, PATH).collect() == []
    for r in tokencount.with_counts(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len((r["text"] or "").encode()), len(library.encode(r["text"] or "")))


# importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def drawn(docs, target, share=25, least=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of each document, without any bucket table."""
    runs = lambda text: [*(w := words(text)), *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]
    counts = lambda rows: Counter(zlib.crc32(f.encode()) % buckets for _, t in rows for f in runs(t))
    s, t = counts(docs), counts(target)
    S, T = s.total(), t.total()
    out = []
    for i, text in docs:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in runs(text))]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(gains), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    places = {id(r): k for k, r in enumerate(order[: len(order) * share // 100], 1)}
    return [(*r[:4], places.get(id(r))) for r in out]


def plain(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("block_bytes", [300, 2_000_000])
def test_importance_by_brute_force(spark, block_bytes):
    rng = random.Random(block_bytes)
    names = [f"w{k}" for k in range(60)] + ["The", "ünder"]
    docs = [(i, " ".join(rng.choice(names) if rng.random() < 0.5 else "the" for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(1000, docs[5][1]), (1000, docs[5][1]), (None, "no id " * 20)]
    target = [(i, " ".join(rng.choice(names[:9]) for _ in range(30))) for i in range(20)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(target, "doc_id long, text string")
    found = importance.resample(a, b, block_bytes=block_bytes, parts=4).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert plain(found) == plain(drawn(docs, target)) and sum(r["rank"] is not None for r in found) > 30


def test_importance_on_edge_cases(spark, edge, nothing):
    target = edge.where("doc_id = 5")
    rows = importance.resample(edge, target, least_words=1, share=100).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert plain(rows) == plain(drawn(EDGE, [(5, EDGE[4][1])], 100, 1))
    assert importance.resample(nothing, target).collect() == []
    assert plain(importance.resample(edge, nothing).select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain(drawn(EDGE, []))
    assert all(r["rank"] is None for r in importance.resample(edge, target, share=0).collect())


def test_importance_features_across_steps():
    text = [b"a", b"b", b"c", b"d", b"e"]
    assert Counter(importance.features_of(text, 3, 1000, step=2).tolist()) == Counter(importance.features_of(text, 3, 1000).tolist()) == Counter(zlib.crc32(b" ".join(text[i : i + n])) % 1000 for n in (1, 2, 3) for i in range(6 - n))
    for top in (3, 300, 70_000):
        assert importance.unpacked(importance.packed(importance.np.array([0, top])), 2).tolist() == [0, top]


# fill-in-middle


def test_infill_by_hand(spark, edge, nothing):
    made = infill.fill_in_middle(edge)
    back = made.withColumn("back", infill.restored(made["output"], made["form"])).collect()
    assert len(back) == len(EDGE) and set(made.columns) == {*edge.columns, "prefix_chars", "middle_chars", "output", "output_sha256"}
    for r in back:
        text = r["text"] or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        h = [int(hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        assert r["n"] == len(units) and r["back"]["text"] == text and r["back"]["sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if not text or "<P>" in text or h[2] % 100 >= 50:
            assert (r["form"], r["output"], r["prefix_chars"], r["middle_chars"]) == ("plain", text, None, None)
            continue
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "spm" if h[3] % 100 < 80 else "psm"
        assert r["form"] == form and r["output"] == (f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}")
        assert (r["prefix_chars"], r["middle_chars"]) == (len(pre), len(mid)) and r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
    assert infill.fill_in_middle(nothing).collect() == []


def test_infill_reads_back_any_text():
    rng = random.Random(5)
    forms = Counter()
    for i in range(4000):
        text = "".join(rng.choice(["<", "P", "S", "M", ">", " ", "\n", "a", "é", "<P", "S>", "\x1c", " "]) for _ in range(rng.randrange(25)))
        n, form, pre, mid, out = infill.transform(text, str(i), share=90)
        forms[form] += 1
        assert infill.read_back(out, form) == text and n == len(infill.unit_ends(text)) - 1 and "".join(text) == text
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 100


def test_infill_on_long_blank_runs():
    assert list(infill.unit_ends(" " * 1_000_000 + "x" + "\t" * 1_000_000)) == [0, 1_000_001, 2_000_001]
