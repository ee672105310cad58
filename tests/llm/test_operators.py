"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import os
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quillpanel.llm import bpe, chat, common, decontam, graph, html, langid, licenses, maxent, simhash, syncmers, toxicity
from quillpanel.llm.queries import QUERIES, vocabulary_path

DOCS = "doc_id long, text string, lang string, score double, node string, word string"
EDGE = [(1, None), (2, ""), (3, "  \n\t "), (4, "x"), (5, "same text of some words here"), (6, "same text of some words here"), (6, "same text of some words here"), (None, "no id"), (7, "long " * 30_000)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", 0.5, "n", "w") for i, t in EDGE], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1 toxicity


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id").limit(4000)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(some.select("doc_id", "text"), model).join(labels, "doc_id").where("held_out").collect()
    hits = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert hits[1, 1] >= 0.65 * (hits[1, 1] + hits[1, 0]) and hits[0, 1] <= 0.05 * (hits[0, 0] + hits[0, 1])


def test_toxicity_windows_cover_every_word():
    data, begin, end, owner = toxicity.windows([[b"a", b"bb", b"c"], [], [b"%d" % i for i in range(21)]], 8, 4)
    seen = {k: b"".join(data[b:e] for b, e, o in zip(begin, end, owner, strict=True) if o == k).split() for k in (0, 1, 2)}
    assert set(seen[0]) == {b"a", b"bb", b"c"} and seen[1] == [] and set(seen[2]) == {b"%d" % i for i in range(21)}


def test_toxicity_learns_from_the_end_of_long_texts(monkeypatch):
    build, pieces = toxicity._dictionary, []
    monkeypatch.setattr(toxicity, "_dictionary", lambda size, samples: (pieces.extend(samples), build(size, samples))[1])
    toxicity.fit([(" ".join(f"common{j % 50}" for j in range(900)) + f" late{i}", i % 2) for i in range(60)])
    made = [i for i in range(0, 60, 2) if zlib.crc32((" ".join(f"common{j % 50}" for j in range(900)) + f" late{i}").encode()) % 3]
    assert made and {b"late%d" % i for i in made} <= set(b" ".join(pieces).split())


def test_toxic_passages_come_from_toxic_text():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    prose = [" ".join(rng.choice(words, 60)) for _ in range(400)]
    rude = ["awful horrid nonsense", "dreadful rubbish indeed", "utterly vile drivel"]
    toxic = [t.replace(" ", f" {rude[i % 3]} ", 1) for i, t in enumerate(prose[:120])]
    found = toxicity.toxic_passages([toxicity.words_of(t) for t in toxic], toxicity.word_texts([toxicity.words_of(t) for t in prose[200:]]), len(prose[200:]), 2)
    assert len({p for p in found if b"awful" in p}) > 30 and all(any(w.encode() in p for r in rude for w in r.split()) for p in found)  # with their neighbours
    model = toxicity.fit([(t, 1) for t in toxic] + [(t, 0) for t in prose[120:]], toxic_bytes=2048)
    assert (model.score([f"{' '.join(rng.choice(words, 30))} {r}" for r in rude]) >= 0.5).all() and (model.score([" ".join(rng.choice(words, 40)) for _ in range(20)]) < 0.5).mean() > 0.9


def test_toxicity_gain_by_hand():
    model = toxicity.fit([("nice words here " * 5, 0), ("vile words here " * 5, 1)] * 3)
    text = "some vile words here and more of them in this text so that it has several windows"
    words = toxicity.words_of(text)
    pair = [toxicity.compressor(d) for d in (model.ordinary, model.toxic)]
    gains = []
    for i in range(0, max(1, len(words) - 4), 4):
        piece = b" " + b" ".join(words[i : i + 8]) + b" "
        gains.append(len(pair[0].compress(piece)) - len(pair[1].compress(piece)))
    want = [np.sqrt(np.mean([g > k for g in gains])) for k in range(toxicity.GAINS)] + [np.mean([max(g, 0) for g in gains]), min(max(*gains, 0), 12), np.mean([max(-g, 0) for g in gains])]
    assert np.allclose(model.features([text])[0], want)


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, 1), (7, 0, 0), (4, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(edge, toxicity.train(edge, labels)).collect()
    assert len(out) == len(EDGE) and all(0 <= r["score"] <= 1 for r in out) and {r["held_out"] for r in out if r["doc_id"] is None} == {False}
    model = toxicity.train(nothing, labels.limit(0))
    assert toxicity.score(nothing, model).count() == 0 and toxicity.score(edge, model).where("predicted = 1").count() == 0


# 2 language


def test_language_accuracy_and_und(spark):
    docs = docs_of(spark, "/root/testdata/sf0.01")
    rows = langid.identify(docs.select("doc_id", "text"), langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 9):
        code = langid.codewords(n)
        assert len(code) == n and min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= max(1, code.shape[1] // 3)


def test_language_edges(spark, edge, nothing):
    model = langid.train(edge)
    out = {r["doc_id"]: r for r in langid.identify(edge, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0 and out[7]["lang_pred"] == "en"
    digits = spark.createDataFrame([(1, "123 456 !!")], "doc_id long, text string")
    assert langid.identify(digits, model).first()["lang_pred"] == "und"
    assert langid.identify(nothing, langid.train(nothing)).count() == 0 and langid.identify(edge, langid.train(nothing)).where("lang_pred <> 'und'").count() == 0


# 3 html


def test_html_articles(spark, sf):
    from html import unescape

    rows = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>", "", p))).strip() for p in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<article>x<aside>y</aside>z</article><p>out</p>", "x\nz"), ("<p>a &lt;b&gt; &amp c</p>", "a <b> & c"), ("<p>a<p>b<script>var x='</p>'</script>", "a\nb"),
        ("<nav><a href=x>menu</a></nav><article>body  of\n it</article><footer>f</footer>", "body of it"), ("<article>t<div class='comments'><p>nice</p></div></article>", "t"), ("<article>t</article><foot", "t"),
        ("<header>site</header><article><header><h1>h</h1></header>b</article>", "h\nb"), ("<div class='cookie-notice'>we use</div><p>" + "word " * 30 + "</p>", ("word " * 30).strip()),
    ],
)
def test_html_pages(page, text):
    assert html.main_text(page) == text


def test_html_class_names_are_whole_names():
    body = "Body of the text. " * 5
    for page in (
        f"<article><section id='share-prices'><p>{body}</p></section></article>", f"<article class='post'><div class='social-science'><p>{body}</p></div></article>", f"<article><label>{body}</label></article>",
        f"<div class='sidebar widget-area'>menu text</div><p>{body}</p><div id='comments-section'><p>{body}</p></div>", f"<main><div class='ad-box'>buy</div><p>{body}</p></main><div class='site-footer'>x</div>",
    ):
        assert html.main_text(page) == body.strip()


def test_html_pages_without_an_article():
    long, short = "word " * 200, [f"short line {i}" for i in range(5)]
    body = "".join(f"<p>{x}</p>" for x in [*short, long, *short])
    want = "\n".join([*short, long.strip(), *short])
    assert html.main_text(f"<nav>menu</nav><div>{body}</div><footer>f</footer>") == want
    assert html.main_text(f"<div>Welcome</div><nav>menu</nav><h1>Title</h1><div>{body}</div><form>x</form><div>Some company</div>").endswith(want + "\nSome company") is False
    teasers = "".join(f"<article><p><a href=x>teaser {i}</a></p></article>" for i in range(3))
    assert html.main_text(f"<div>{body}</div><aside>a</aside>{teasers}") == want  # articles of links alone are none
    assert html.main_text(f"<div><p>intro</p></div><article><p>{long}</p><p>end</p></article><div>outside</div>") == f"{long.strip()}\nend"


def test_html_articles_are_never_lost():
    other = "word " * 250
    assert html.main_text(f"<article><p>Short.</p></article><div>{other}</div>").split("\n")[0] == "Short."
    assert html.main_text("<article><p>a</p><section id='search'><p>b</p></section><section class='comments'><p>c</p></section><p>d</p></article>") == "a\nb\nd"
    assert html.main_text("<article><ul><li><a>share</a></li><li><a>print</a></li></ul><h1><a>Title</a></h1><p>x</p><p><a>y</a></p><p>z</p><p><a>tweet</a></p></article>") == "Title\nx\ny\nz"


def test_html_deep_nesting_takes_linear_time():
    began = time.time()
    for page in ("<div>" * 100_000 + "</span>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<div><b>" * 50_000 + "x" + "</b></div>" * 50_000):
        assert html.main_text(page) == "x"
    assert time.time() - began < 6


def plain_main_text(zones, window=3, share=0.3):
    """The rule on zones of (kind, [(text, characters outside links, run)]), by its words."""
    weigh = {"article": 16, "main": 4, "": 1}
    sums = lambda w, i: sum(w[max(i, 0) : i + window])
    heaviest = max((sums([weigh[k] * p for _, p, _ in z], i) for k, z in zones for i in range(len(z))), default=0)
    out = []
    for kind, z in zones:
        w = [weigh[kind] * p for _, p, _ in z]
        least = 1 if kind == "article" else max(1, share * heaviest)
        begin = next((i for i in range(len(z)) if w[i] and sum(w[i : i + window]) >= least), None)
        end = next((i for i in reversed(range(len(z))) if w[i] and sum(w[max(0, i - window + 1) : i + 1]) >= least), None)
        if begin is None or end is None or begin > end:
            continue
        if kind == "main":
            begin, end = 0, len(z) - 1
        while begin and z[begin - 1][1] and z[begin - 1][2] == z[begin][2]:
            begin -= 1
        while end + 1 < len(z) and z[end + 1][1] and z[end + 1][2] == z[end][2]:
            end += 1
        out += [t for t, _, _ in z[begin : end + 1]]
    return "\n".join(out)


def test_html_equals_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(400):
        page, zones, run, count = "", [], 0, 0
        for _ in range(rng.integers(1, 5)):
            kind = str(rng.choice(["article", "main", ""]))
            made, lines = "", []
            for _ in range(rng.integers(1, 7)):
                if rng.random() < 0.2:
                    made, run = made + "<nav><p>menu</p></nav>", run + 1
                    continue
                count += 1
                text = f"line {count} " + "w" * int(rng.integers(1, 60) if rng.random() < 0.7 else 400)
                linked = rng.random() < 0.3
                made += f"<p><a href=x>{text}</a></p>" if linked else f"<p>{text}</p>"
                lines.append((text, 0 if linked else len(text), run))
            page += f"<{kind}>{made}</{kind}>" if kind else f"<div>{made}</div>"
            if kind or not zones or zones[-1][0]:
                zones.append((kind, lines))
            else:
                zones[-1][1].extend(lines)
        assert html.main_text(page) == plain_main_text([z for z in zones if z[1]]), page


def test_surge_and_dive_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        w = rng.choice([0, 0, 1, 5, 40], rng.integers(1, 12)).astype(float)
        least = float(rng.choice([1, 6, 41, 80]))
        begin = [i for i in range(len(w)) if w[i] > 0 and sum(w[i : i + 3]) >= least]
        end = [i + 1 for i in range(len(w)) if w[i] > 0 and sum(w[max(0, i - 2) : i + 1]) >= least]
        assert html.surge_and_dive(w, 3, least) == ((begin[0], end[-1]) if begin and end else (0, 0))


def test_html_long_page():
    body = [f"paragraph {i} of a very long page" for i in range(40_000)]
    assert html.main_text("<article>" + "".join(f"<p>{x}" for x in body)) == "\n".join(body)


def test_html_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, "clash"), (2, None, "<p>x", "clash"), (2, None, "<p>x", "clash")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in html.extract(pages).orderBy("page_id").collect()] == ["", "x", "x"]
    assert html.extract(pages.limit(0)).count() == 0


# 4 BPE


def test_bpe_equals_the_library(spark, sf, edge, nothing):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    odd = ["Hello <|endoftext|> Wörld ΑΣ 12's a\x1cb", "İstanbul ǅ ﬁ ½ ٣ 漢字 é \x85 'S 'RE don't", "<|startoftext|><|endoftext|>", "a b c"]
    docs = docs_of(spark, sf).select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string")).union(edge.select("doc_id", "text"))
    got = bpe.encode(docs, path, lexicon_size=500).collect()
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["ids_decoded"] == library.decode(ids, skip_special_tokens=False)
    digest = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert digest == {(r["doc_id"], len(r["ids"]), sha(" ".join(map(str, r["ids"]))), sha(r["ids_decoded"])) for r in got}
    assert bpe.digests(nothing, path).count() == 0


def test_bpe_merges_long_words_and_many_at_once():
    from tokenizers import Tokenizer

    path = vocabulary_path()
    vocab, library, rng = bpe.vocabulary(path), Tokenizer.from_file(path), np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeinrst\u00e9\u6f22"), n)) for n in rng.integers(1, 90, 400)] + ["xyzab" * 40_000, "a", "aa" * 32, "aa" * 33]
    ids, sizes = vocab.merge_all([w.encode() for w in words])
    for w, got in zip(words, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == library.encode(w, add_special_tokens=False).ids


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): (i, i + 1) for i, w in enumerate(["walking", "talking", "walked", "talked", "a", "walk"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    found = lexicon.numbers([*words, b"walke", b"", b"zzz"])
    assert [tuple(lexicon.ids[lexicon.offsets[n] : lexicon.offsets[n + 1]]) for n in found[: len(words)]] == list(words.values())
    assert (found[len(words) :] == -1).all() and len(lexicon.final) < 16  # suffixes are shared


# 5 language model


def plain_words(text):
    return [w.lower() for w in (text or "").encode().split()]


def test_maxent_counts_and_gain(spark, sf):
    rows = maxent.score(docs_of(spark, sf)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs_of(spark, sf).collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*plain_words(t), b"\n"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = [*plain_words(texts[r["doc_id"]]), b"\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), n) and r["base_score"] == pytest.approx(base)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_maxent_score_by_hand(spark, monkeypatch):
    """The scores against a token-by-token walk with the trained weights, and a table of classes that sums to one."""
    texts = ["a b c a \u00c9 b", "b b d", "a e f g h", "q r s t", None, "A  b\tzz qq zz", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    train, models = maxent.train_weights, []
    monkeypatch.setattr(maxent, "train_weights", lambda rows, model, *more: (train(rows, model, *more), models.append(model)))
    rows = {r["doc_id"]: r["score"] for r in maxent.score(docs, frequent=4, singles=2, named=3, bins=2, groups=3).collect()}
    model, counts = models[0], Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*plain_words(t), b"\n"])
    frequent = [w.encode() for w in model.words.to_pylist()]
    assert frequent == sorted((w for w in counts if w != b"\n"), key=lambda w: (-counts[w], w))[:4]

    def kind(w):
        return 0 if w == b"\n" else int(model.classes[frequent.index(w)]) if w in frequent else int(model.rare_class(pa.array([w.decode()]))[0])

    mass = Counter()
    for w, c in counts.items():
        mass[kind(w)] += c + 0.5
    for g in range(3):
        mass[1 + model.singles + g * 3] += 0.5
    for i, t in enumerate(texts):
        said, total = [b"\n", b"\n", *plain_words(t), b"\n"], 0.0
        for before, last, w in zip(said, said[1:], said[2:], strict=False):
            symbol = model.size + frequent.index(last) if last in frequent[:3] else kind(last)
            logs = model.log_classes(model.features(np.array([symbol * model.size + kind(before)])))[0]
            assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
            total += logs[kind(w)] / math.log(10) + math.log10((counts[w] + 0.5) / mass[kind(w)])
        assert rows[i] == pytest.approx(total, rel=1e-5)


def test_maxent_is_the_same_in_any_partitions(spark, sf):
    found = [{r["doc_id"]: r["score"] for r in maxent.score(docs_of(spark, sf).repartition(n)).collect()} for n in (1, 4, 32)]
    assert all(found[0][i] == pytest.approx(f[i], rel=1e-9) for f in found[1:] for i in found[0])


def test_maxent_trains_on_every_text(spark, monkeypatch):
    train, models = maxent.train_weights, []
    monkeypatch.setattr(maxent, "train_weights", lambda rows, model, *more: (train(rows, model, *more), models.append(model)))
    texts = [(i, f"w{i} w{i} v{i % 7}") for i in range(900)]
    maxent.score(spark.createDataFrame(texts, "doc_id long, text string"), named=2000)
    model = models[0]
    seen = set()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            number, text, rare, words = model.tokens(pa.array([t]))
            seen |= set(model.features(model.context(number, model.kinds(number, rare, words), text)).ravel().tolist())
    assert set(np.flatnonzero(model.weights.any(axis=1)).tolist()) == seen


def test_maxent_edges(spark, edge, nothing):
    out = maxent.score(edge).collect()
    assert len(out) == len(EDGE) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {1} and all(np.isfinite(r["score"]) for r in out)
    assert maxent.score(nothing).count() == 0


# 6 SimHash


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(ids, 2):
            if (prints[a] ^ prints[b]).bit_count() <= radius and label[a] != label[b]:
                low = min(label[a], label[b])
                label = {i: low if x in (label[a], label[b]) else x for i, x in label.items()}
                changed = True
    return label


def test_simhash_equals_brute_force(spark, sf):
    docs = docs_of(spark, sf)
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    out = QUERIES["op6_simhash"](spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in out} == plain_components(prints, 4)


def test_bk_forest_finds_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    rows = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 20)] + [base]))[:, None]
    group = np.sort(rng.integers(0, 5, len(rows)))
    a, b = simhash.BKForest(group, rows).within(np.arange(len(rows)), 4)
    want = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if group[i] == group[j] and (int(rows[i, 0]) ^ int(rows[j, 0])).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_hot_shards_lose_no_link(spark):
    rows = np.unique(np.random.default_rng(5).integers(0, 2**63, 300, dtype=np.uint64))
    near = rows[:100] ^ np.uint64(7)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in np.unique(np.concatenate([rows, near])).view(np.int64)], "node long, f0 long")
    whole = graph.components(simhash.links(nodes, simhash.block_masks(400, 4), 4)).collect()
    tiled = graph.components(simhash.links(nodes, np.zeros((1, 1), np.uint64), 4, tile=50)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, tiled)) and len(whole) == 200


def test_simhash_edges(spark, edge, nothing):
    out = [(r["doc_id"], r["f0"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()]
    assert len(out) == len(EDGE) and {c for i, f, c in out if f == 0} == {1} and {c for i, _, c in out if i in (5, 6)} == {5}
    assert simhash.near_duplicates(nothing).count() == 0


def test_components_of_paths_and_loops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 50), (60, 61), (61, 60), (60, 61)], "a long, b long")
    out = dict(map(tuple, graph.components(edges).collect()))
    assert {out[i] for i in range(1, 41)} == {1} and out[60] == out[61] == 60 and 50 not in out


# 7 licences


def test_licences(spark, nothing):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "a/LICENSE", gpl), (2, "a/b/c/x.txt", "nothing to see here"), (3, "a/b/y.txt", "some prose\nReleased under the MIT License.\nmore prose " + "word " * 50), (4, "z/q.txt", None), (5, None, ""),
        (6, "a/b/NOTICE", "Licensed under the Apache License, Version 2.0."), (7, "a/z.txt", "plain prose"), (7, "a/z.txt", "plain prose"), (8, "root.txt", "long " * 20_000),
    ]
    files = spark.createDataFrame([(*r, "c", "d") for r in rows], "key long, path string, text string, license string, basis string")
    out = {r["key"]: (r["license"], r["basis"], r["from_path"]) for r in licenses.scan(files).collect()}
    assert out[1] == ("GPL-3.0", "file", "a/LICENSE") and out[2] == ("Apache-2.0", "inherited", "a/b/NOTICE") and out[3] == ("MIT", "header", "a/b/y.txt")
    assert out[7] == ("GPL-3.0", "inherited", "a/LICENSE") and out[4][1] == out[5][1] == out[8][1] == "none" and licenses.scan(files).count() == len(rows)
    assert licenses.scan(nothing.selectExpr("doc_id AS key", "text AS path", "text")).count() == 0


def test_licence_headers_and_files(spark):
    import textwrap

    scanner = licenses.build(spark.createDataFrame([("some prose of no licence",)], "text string"), licenses.TEMPLATES, 0.75)
    code = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(40))
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            wrapped = textwrap.wrap(text, 70)
            for mark in ("# ", "// ", " * "):
                found = scanner.scan("\n".join(mark + x for x in wrapped) + "\n" + code)
                assert found[0] == name and found[1] > 0.95, (name, text)
            assert scanner.scan("Copyright (c) 2020 Some Author\n\n" + "\n".join(wrapped))[0] == name
    mit = licenses.TEMPLATES["MIT"][2]
    assert scanner.scan("MIT License\n\nCopyright (c) 2020 A. Body\n\n" + textwrap.fill(mit, 78))[2] > 0.95 and scanner.scan(code)[0] is None


def test_whole_licence_files(spark):
    """Licence files as they are shipped, where this machine has them."""
    folder, named = "/usr/share/common-licenses", {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    there = [n for n in named if os.path.exists(f"{folder}/{n}")]
    if not there:
        pytest.skip("no licence files here")
    rows = [(i, f"p{i}/LICENSE", open(f"{folder}/{n}", encoding="utf-8").read()) for i, n in enumerate(there)] + [(100 + i, f"p{i}/src/a.py", "x = 1") for i in range(len(there))]
    out = {r["key"]: r for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    for i, n in enumerate(there):
        assert (out[i]["license"], out[i]["basis"]) == (named[n], "file") and (out[100 + i]["license"], out[100 + i]["basis"]) == (named[n], "inherited")


def test_licence_passages_equal_brute_force(spark, sf):
    """Cosines over every passage, word by word, and inheritance by walking up the directories."""
    rows = [(r["doc_id"], "/".join([r["source"] or "x", r["lang"] or "y", f"{r['doc_id'] % 5}", f"{r['doc_id']}.txt"]), r["text"]) for r in docs_of(spark, sf).collect()]
    source, lang = rows[0][1].split("/")[:2]
    rows += [(-1, f"{source}/LICENSE", "Released under the MIT License."), (-2, f"{source}/{lang}/3/COPYING", "Licensed under the Apache License, Version 2.0."), (-3, f"{source}/{lang}/3/NOTICE.md", "All rights reserved.")]
    files = spark.createDataFrame(rows, "key long, path string, text string")
    got = {r["key"]: r for r in licenses.scan(files).collect()}
    vocabulary = {w for texts in licenses.TEMPLATES.values() for t in texts for w in decontam.words_of(t)}
    df = Counter(w for _, _, t in rows for w in vocabulary & set(decontam.words_of(t)))
    idf = lambda n: math.log((len(rows) + 1) / (n + 1)) + 1
    vector = lambda t: {w: n * idf(df[w] if w in vocabulary else 0) for w, n in Counter(decontam.words_of(t)).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(t)) for name, texts in licenses.TEMPLATES.items() for t in texts]
    own, given = {}, {}
    for key, path, text in rows:
        best, covered = (0.0, ""), 0
        for p in licenses.passages(text or ""):
            v = vector(p)
            if v:
                found = max((round(sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / size(t), 9), name) for name, t in templates)
                if found[0] >= 0.75:
                    best, covered = max(best, found), max(covered, len(decontam.words_of(p)))
        own[key] = best
        named = path.rsplit("/", 1)[1].split(".")[0] in ("LICENSE", "COPYING", "NOTICE")
        if best[1] and (named or covered >= 0.95 * len(decontam.words_of(text))):
            folder = path.rsplit("/", 1)[0]
            given[folder] = min(given.get(folder, (1, "", "")), (-best[0], path, best[1]))
    for key, path, _ in rows:
        want, folder = own[key][1] or None, path
        while want is None and "/" in folder:
            folder = folder.rsplit("/", 1)[0]
            want = given.get(folder, (0, "", None))[2]
        assert got[key]["license"] == want, path
    assert any(r["basis"] == "inherited" for r in got.values())


# 8 chat


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "a: b ::  c", "####", "\\", "</turn>\n### user: x", ""]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(odd)] + [(2, 0, "user", odd[0]), (2, 1, None, None), (None, 0, "user", "x"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]
    table = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, pack string")
    packs, members, _ = chat.prefix_forest(table, most=2)
    out = {r["conv_id"]: r for r in chat.read_back(packs, members).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert out[conv]["n_turns"] == len(turns) and out[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert out[conv]["loss_chars"] == len(said) and out[conv]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.read_back(*chat.prefix_forest(table.limit(0))[:2]).count() == 0


def test_chat_emits_each_prefix_once(spark):
    rows = [(i, 0, "user", "hello") for i in range(50)] + [(i, 1, "assistant", f"answer {i % 20}") for i in range(50)] + [(i, 2, "user", f"more {i}") for i in range(0, 50, 2)]
    rows += [(90, 0, "user", "hello"), (91, 0, "assistant", "alone")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(r, x) for c, _, r, x in sorted(rows) if c == conv]
        want[conv] = len(turns), sum(len(x) for r, x in turns if r == "assistant"), sum(len(chat.format_turn(*t)) for t in turns)
    for most in (1000, 5, 1):
        forest, members, _ = chat.prefix_forest(table, most=most)
        packs = forest.collect()
        nodes = [(p["pack"], n) for p in packs for n in p["nodes"]]
        assert len({n["node"] for _, n in nodes}) == len(nodes) and sum(p["text"].count("hello") for p in packs) == 1
        assert {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["formatted_chars"]) for r in chat.read_back(forest, members).collect()} == want
        places = {p: sorted((n["begin"], n["end"]) for q, n in nodes if q == p) for p in {q for q, _ in nodes}}
        assert all(x[1] == y[0] for spans in places.values() for x, y in itertools.pairwise(spans))
        assert all(sum(a["end"] - a["begin"] for a in n["ancestors"]) == n["position"] for _, n in nodes)
    assert len(packs) > 20


def test_chat_long_and_repeated_conversations(spark):
    long = [(1, i, ("user", "assistant")[i % 2], f"turn {i % 7}") for i in range(3000)] + [(2, 0, "assistant", "word " * 100_000)]
    table = spark.createDataFrame(long + [(c, 0, "user", "the same") for c in range(10, 400)], "conv_id long, turn long, role string, text string")
    forest, members, _ = chat.prefix_forest(table, most=100)
    out = {r["conv_id"]: r for r in chat.read_back(forest, members).collect()}
    assert len(out) == 392 and out[1]["n_turns"] == 3000 and out[2]["loss_chars"] == 500_000 and sum(p["text"].count("the same") for p in forest.collect()) == 1


# 9 decontamination


def test_decontamination_equals_brute_force(spark, sf):
    docs, bench = docs_of(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    windows = {}
    for r in bench.collect():
        w = decontam.words_of(r["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(r["item_id"]))
    want = {}
    for r in docs.collect():
        w, hit, items = decontam.words_of(r["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[k]
        want[r["doc_id"]] = (len(w), len(hit), len(items), decontam.digest_of(list(items)), bool(hit) and 20 * len(hit) >= len(w))
    for options in ({}, {"block_words": 300, "shard_words": 100}):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs, bench, **options).collect()}
        assert got == want
    assert any(x[4] for x in want.values())


def test_decontamination_edges(spark, edge, nothing):
    bench = spark.createDataFrame([(1, "same text of some words here", "c"), (1, "same text of some words here", "c"), (2, None, "c"), (None, "x", "c"), (3, "", "c")], "item_id long, text string, spans string")
    out = decontam.contamination(edge, bench).collect()
    assert len(out) == len(EDGE) and {r["n_hit"] for r in out if r["doc_id"] in (5, 6)} == {6} and {r["n_words"] for r in out if r["doc_id"] in (1, 2, 3)} == {0}
    assert {(r["n_hit"], r["n_items"]) for r in out if r["doc_id"] == 4} == {(1, 1)}
    assert decontam.contamination(nothing, bench).count() == 0 and decontam.contamination(edge, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.contamination(edge, bench, block_words=2).count() == len(EDGE)


def test_decontamination_in_any_number_of_blocks(spark):
    """Rows without an id, or that share one, keep their own hits; an item called null is not the one without an id."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[i : i + 13]) for i in (0, 20, 40)]
    docs = [(None, texts[0]), (None, texts[1]), (None, " ".join(reversed(words[:13]))), (7, texts[0]), (7, texts[2]), (7, " ".join(words[5:18])), (8, None), (9, f"{texts[0]} x {texts[1]}"), (9, f"{texts[0]} x {texts[1]}")]
    table = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, row int").repartition(3)
    bench = spark.createDataFrame([("null", texts[0]), (None, texts[0]), ("b", texts[1]), ("c", texts[2]), ("c", texts[2])], "item_id string, text string")
    shown = lambda **o: sorted(map(repr, (tuple(r) for r in decontam.contamination(table, bench, **o).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans").collect())))
    one = shown()
    assert one == shown(block_words=5) == shown(block_words=30, shard_words=10)
    assert sorted(eval(r.replace("Row", "dict"))[1:4] for r in one) == sorted([(13, 13, 2), (13, 13, 1), (13, 0, 0), (13, 13, 2), (13, 13, 1), (13, 0, 0), (0, 0, 0), (27, 26, 3), (27, 26, 3)])


def test_samples_to_fit_on_are_bounded(spark):
    rows = [(5, "hot", f"hot text {i}") for i in range(3000)] + [(i, "en", "x" * i) for i in range(10, 60)] + [(i, "de", "y") for i in range(40)] + [(99, "en", None)]
    table = spark.createDataFrame(rows, "id long, label string, text string")
    found = common.bounded_sample(table, "test", 20, 500)
    assert max(Counter(r[2] for r in found).values()) <= 20 and sum(len(r[1]) for r in found) <= 500
    assert found == common.bounded_sample(table.repartition(7), "test", 20, 500) and len(common.bounded_sample(table, "test", 3000, 10**6)) == 91
    assert common.bounded_sample(table.limit(0), "test", 20, 500) == []


def test_a_hot_labelled_id_is_one_text(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"vile words {i}", "en") for i in range(2000)] + [(i, f"nice words here {i}", "de") for i in range(2, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)] + [(1, 1)] * 50, "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda rows: seen.setdefault("toxic", list(rows)))
    monkeypatch.setattr(langid, "fit", lambda rows: seen.setdefault("lang", list(rows)))
    toxicity.train(docs, labels)
    langid.train(docs, per_language=3000)
    kept = {i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen["toxic"]) == len(kept) == len(seen["lang"])


def test_fm_index_on_repeats():
    rng = np.random.default_rng(1)
    runs = [rng.integers(1, 4, n) for n in (50, 3, 80)] + [np.array([1, 1, 1, 1, 1, 1])] * 3
    index = decontam.FMIndex(runs, every=4)
    patterns = [(1, 1), (2, 3, 1), (1,), (3, 3, 3), (9,), (1, 1, 1, 1)]
    table = np.zeros((len(patterns), 4), np.int64)
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = p
    lo, hi = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = sorted(int(s) + i for s, r in zip(index.starts, runs, strict=True) for i in range(len(r) - len(p) + 1) if tuple(r[i : i + len(p)]) == p)
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 10 syncmers


def plain_anchors(text, k=16, s=5):
    """Closed syncmers by their definition, hashed sign by sign in whole numbers."""

    def mixed(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def hashed(run):
        x = 0
        for c in run:
            x = (x * 0x100000001B3 + ord(c)) % 2**64
        return mixed(x)

    inner = [hashed(text[i : i + s]) for i in range(len(text) - s + 1)]
    found = [(i, hashed(text[i : i + k])) for i in range(len(text) - k + 1) if i in (0, len(text) - k) or min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return found or [(0, hashed(text))] * bool(text)


def plain_fingerprint_of(text):
    return [(i, h >> 32) for i, h in plain_anchors(text)]


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    chains, sides = [], []
    for found in (a, b):
        seen, side = Counter(), {}
        for i, h in found:
            side[h, seen[h]] = i
            seen[h] += 1
        sides.append(side)
    pairs = sorted((i, sides[1][key]) for key, i in sides[0].items() if key in sides[1])
    for n, (_, y) in enumerate(pairs):
        chains.append(1 + max((chains[m] for m in range(n) if pairs[m][1] < y), default=0))
    return 2 * max(chains, default=0) / (len(sides[0]) + len(sides[1]))


def test_syncmers_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = docs_of(spark, sf).select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in syncmers.compare_with_next(docs_of(spark, sf)).collect()}
    assert len(got) == len(rows)
    prints = [plain_fingerprint_of(r["text"]) for r in rows]
    for n, (r, after) in enumerate(zip(rows, [*rows[1:], rows[0]], strict=True)):
        m = len(r["text"]) // 4
        edited = r["text"][: len(r["text"]) - m] + after["text"][:m]
        g, made = got[r["doc_id"]], plain_fingerprint_of(edited)
        assert g["n_chars"] == len(r["text"]) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for text, want in ((g["fingerprint"], prints[n]), (g["edited_fingerprint"], made)):
            steps = [y - x for x, y in zip([0, *(i for i, _ in want)], (i for i, _ in want), strict=False)]
            assert text == "".join(f"{x:02x}" for x in steps) + "".join(f"{h:08x}" for _, h in want)
        assert g["near_edited"] == pytest.approx(plain_likeness(prints[n], made)) and g["near_next"] == pytest.approx(plain_likeness(prints[n], prints[(n + 1) % len(rows)]))
    assert np.median([r["near_edited"] for r in got.values()]) > 0.6 and np.median([r["near_next"] for r in got.values()]) < 0.05


def test_syncmers_see_order_and_passages():
    rng = np.random.default_rng(4)
    words = [["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)] for n in (3000, 3000, 60)]
    a, b = " ".join(words[0]), " ".join(words[1][:1500] + words[2] + words[1][1500:])
    with_passage = " ".join(words[0][:700] + words[2] + words[0][700:])
    swapped = " ".join(words[0][1500:] + words[0][:1500])
    prints = [syncmers.fingerprint(p, h) for p, h in syncmers.anchors([a, b, with_passage, swapped])]
    assert syncmers.likeness(prints[0], prints[1]) == 0 < syncmers.likeness(prints[1], prints[2]) < 0.1
    assert 0.95 < syncmers.likeness(prints[0], prints[2]) < 1 and 0.4 < syncmers.likeness(prints[0], prints[3]) < 0.6
    assert all((syncmers.from_text(syncmers.to_text(p)) == p).all() for p in prints)


def test_a_changed_word_always_shows():
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9))) for _ in range(900)]
    for n in (40, 400):
        for _ in range(100):
            text = [words[i] for i in rng.integers(0, 900, n)]
            other = list(text)
            other[rng.integers(0, n)] = "zz"
            a, b = (syncmers.fingerprint(p, h) for p, h in syncmers.anchors([" ".join(text), " ".join(other)]))
            assert 0 < syncmers.likeness(a, b) < 1
    far = np.array([[300, 5], [301, 2**32 - 1], [70_000, 0]], np.uint32)
    assert (syncmers.from_text(syncmers.to_text(far)) == far).all() and len(syncmers.from_text("")) == 0


def test_syncmers_split_an_id_of_many_rows(spark):
    lowest = -(2**63)
    rows = [(7, f"text {i} of one id, with its own words {i * i}") for i in range(300)] + [(i, f"other {i}") for i in range(20)] + [(None, "none"), (lowest, "lowest")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    cuts = np.array([7, 7, 7, 9, 12])
    parts = syncmers.Ranges(cuts).of(np.array([0, 7, 7, 7, 8, 9, 20]), np.array([5, -(2**63), 0, 2**63 - 1, 1, 1, 1]))
    assert parts.tolist() == [0, 1, 2, 3, 3, 4, 5]
    out = syncmers.compare_with_next(table).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows) and Counter(r["n_chars"] for r in out) == Counter(len(t) for _, t in rows)


def test_syncmers_edges(spark, edge, nothing):
    out = syncmers.compare_with_next(edge).collect()
    assert len(out) == len(EDGE) and {r["fingerprint"] for r in out if r["doc_id"] in (1, 2)} == {""} and len({r["fingerprint"] for r in out if r["doc_id"] in (5, 6)}) == 1
    assert {r["near_next"] for r in out if r["doc_id"] == 5} == {1.0} and syncmers.compare_with_next(nothing).count() == 0
    one = syncmers.compare_with_next(edge.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert syncmers.anchor_table(edge).where("doc_id = 4").count() == 1
    assert syncmers.fingerprints(edge).where("fingerprint = ''").count() == 2
