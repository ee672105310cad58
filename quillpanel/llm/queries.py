"""One query for each operator, with production parameters, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.llm import bpe, chat, decontam, html, importance, infill, langid, licenses, maxent, simhash, syncmers, tokencount, toxicity
from quillpanel.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The folder of the public vocabularies is a parameter; its package knows where it lies.
def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text"), langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary_path())


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query
def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(read(spark, sf_dir, "documents"))


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_of(F.col("f0")).alias("fingerprint"), "component_id")


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths; source and language stand for their directories."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text"))
    return found.select(F.col("key").alias("doc_id"), "path", "license", "cosine", "basis", "from_path")


#: A conversation that the contract adds; its texts hold the template's own strings.
_ADDED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(_ADDED, "conv_id long, turn long, role string, text string"))
    packs, members, _ = chat.prefix_forest(rows)
    return chat.read_back(packs, members)


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", F.size("spans").cast("long").alias("n_spans"))


@query
def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(read(spark, sf_dir, "documents"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_counts(docs, vocabulary_path("piece_bpe_32k.model")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))["sha256"]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 13) AS n, unnest([list_slice(w, i, i + least(len(w), 13) - 1) for i in range(1, greatest(len(w) - 12, 1) + 1)]) AS p FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS p FROM d, lens, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
hits AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1),
ends AS (SELECT DISTINCT doc_id, i, i + n AS e FROM hits),
marked AS (SELECT doc_id, i, max(e) OVER (PARTITION BY doc_id ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ends),
spans AS (SELECT doc_id, count(*) AS n_spans FROM marked WHERE before IS NULL OR i > before GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

_ESCAPE = r"replace(replace(replace(replace({}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ': ', ':\ ')"

ORACLES["op8_chat"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPE.format("role")}) + length({_ESCAPE.format("text")}) + 15) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

ORACLES["op12_importance"] = rf"""
WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS f FROM b),
names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
sums AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(0, len(h) // 2)]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM names, t),
ds AS (SELECT doc_id, bucket FROM df JOIN sums USING (f)),
s AS (SELECT bucket, count(*) AS s FROM ds GROUP BY 1),
tt AS (SELECT bucket, count(*) AS t FROM bf JOIN sums USING (f) GROUP BY 1),
gains AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM ds) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)))) AS g FROM s LEFT JOIN tt USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM ds JOIN gains USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= (SELECT count(*) FROM scored WHERE n_words >= 20) * 25 // 100 THEN r END AS rank FROM placed
"""

_HASH = "('0x' || substr(h, {}, 8))::BIGINT"

ORACLES["op13_infill"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, {_HASH.format(1)} % (len(u) + 1) AS a, {_HASH.format(9)} % (len(u) + 1) AS b, {_HASH.format(17)} % 100 AS p, {_HASH.format(25)} % 100 AS q FROM d),
f AS (SELECT *, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR p >= 50 THEN 'plain' WHEN q < 80 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(list_slice(u, 1, least(a, b)), ''), '') AS pre, coalesce(array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), ''), '') AS mid,
  coalesce(array_to_string(list_slice(u, greatest(a, b) + 1, len(u)), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM f
"""
