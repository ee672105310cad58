import numpy as np
import pytest

import corpus_pipeline
from quillpanel.llm import decontam, graph, simhash
from quillpanel.llm.common import save


@pytest.fixture(scope="module")
def staged(spark):
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = save(stage(spark, docs, sf), "test-stage")
        out.append((name, docs, new))
        docs = new
    return sf, out


def test_stages_keep_columns_and_shrink(staged):
    for name, before, after in staged[1][:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0.5 * before.count() < after.count() <= before.count(), name
        assert after.join(before, after.columns, "left_anti").isEmpty(), name
    name, before, after = staged[1][-1]
    assert after.count() == before.count() and {"ids", "ids_decoded", "n_tokens"} <= set(after.columns)


def test_copies_leave_one(staged):
    _, before, after = staged[1][2]
    texts = [r["text"] for r in after.collect()]
    assert len(texts) == len(set(texts)) and set(texts) <= {r["text"] for r in before.collect()}

    def grams(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {r["doc_id"]: grams(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    gone = [i for i in sets if i not in kept]
    assert all(max(like(sets[i], sets[j]) for j in sets if j != i) >= 0.65 for i in gone)
    left = [(i, j) for i in kept for j in kept if i < j and abs(len(sets[i]) - len(sets[j])) <= 0.25 * len(sets[i]) and like(sets[i], sets[j]) >= 0.85]
    assert not left


def test_contaminated_go(spark, staged):
    sf, out = staged
    _, before, after = out[3]
    found = decontam.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in found.where("not contaminated").collect()}


def test_texts_that_share_an_id_are_kept_apart(spark):
    one, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = [(1, one), (7, one + " more"), (7, other), (7, other), (9, other + " x"), (9, None), (9, None), (8, "short"), (None, one), (None, one)]
    table = spark.createDataFrame([(*d, "c", 3) for d in docs], "doc_id long, text string, _id string, _row long").repartition(4)
    out = corpus_pipeline.near_dedup_stage(spark, table, "")
    assert out.columns == table.columns and sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(str, [(1, one), (7, other), (9, None), (8, "short"), (None, one), (None, one)]))


def test_repeated_ids_and_nulls(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "c"), (1, text, "c"), (2, text + " eleven", "c"), (3, None, "c"), (None, "other words that stand alone here", "c")], "doc_id long, text string, component_id string")
    out = corpus_pipeline.near_dedup_stage(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in out) in (["1", "2", "3", "None"], ["1", "3", "None"]) and docs.columns == list(out[0].asDict())


def test_likeness_is_decided_at_exactly_four_fifths(spark):
    """80 shared runs of five words and 10 of each text's own are a likeness of 0.8, 11 of its own one of 0.784."""
    rows, gone = [], set()
    for i in range(400):
        own = 10 if i < 200 else 11
        words = [f"w{i}x{j}" for j in range(84)]
        rows += [(2 * i + k, " ".join(words + [f"v{i}y{k}z{j}" for j in range(own)])) for k in (0, 1)]
        if own == 10:
            gone.add(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.copies(docs).collect()} == gone
    assert simhash.expected_loss(0.8) < 1e-4


def test_set_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.choice(1000, 40, replace=False)
        for _ in range(12):
            keep = base[rng.random(40) > rng.choice([0.0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate((keep, rng.choice(1000, rng.integers(0, 6))))).astype(np.uint64))
    rng.shuffle(sets)
    held, want = [set(x.tolist()) for x in sets], list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j])]
    for _ in sets:
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    assert simhash.set_links(sets).tolist() == want and 12 < len(set(want)) < len(sets)
    rows = [(7, i, len(x), x.astype("<u8").tobytes()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "label long, node long, n long, hashes binary")
    for tile in (1 << 19, 500):
        found = {r["node"]: r["label"] for r in graph.components(simhash.exact_links(table, tile)).collect()}
        assert [found.get(i, i) for i in range(len(sets))] == want


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, component_id long, held_out boolean"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_edge_cases(spark, tmp_path, name, stage):
    """Nulls everywhere, empty and very long texts, repeated rows, ties, clashing columns, and empty tables."""
    sf, extra = str(tmp_path), (0.5, "s", 3, True)
    spark.createDataFrame([(1, "one two three of the benchmark"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1), (5, 0, 0), (None, None, None)], "doc_id long, quality long, toxic long").write.parquet(f"{sf}/labels.parquet")
    rows = [(1, None), (2, ""), (3, "  "), (4, "a text of some plain words that is short"), (4, "a text of some plain words that is short"), (5, "a text of some plain words that is short"), (None, None), (7, "long words " * 60_000), (8, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "en" if t else None, None, None, *extra) for i, t in rows], COLUMNS)
    out = stage(spark, docs, sf)
    kept = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(kept) <= len(rows)
    assert {(r["doc_id"], r["text"]) for r in kept} <= set(rows) and all((r["score"], r["spans"], r["component_id"], r["held_out"]) == extra for r in kept)
    if name in ("toxicity", "language ID"):
        assert {r["doc_id"] for r in kept} >= {4, 5, 7, 8}
    elif name == "SimHash near-dedup":
        assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None and r["text"] and r["text"].strip()) == [4, 7, 8]
    else:
        assert len(kept) == len(rows)
    assert stage(spark, docs.limit(0), sf).count() == 0
