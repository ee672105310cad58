"""Documents to token ids: toxicity, language, near-duplicates, benchmark contamination, BPE. Each stage's rows are written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpanel.llm import bpe, decontam, langid, simhash, toxicity
from quillpanel.llm.common import aside, read, save, without
from quillpanel.llm.queries import vocabulary_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from the labelled ones among docs, outside fold 0."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    renamed, back = aside(docs)
    return toxicity.score(renamed, model).where("predicted = 0").select(*back)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; a narrow decision is no ground to reject."""
    model = langid.train(docs)
    renamed, back = aside(docs)
    return langid.identify(renamed, model).where("lang_pred <> 'und'").select(*back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, likeness 0.8) the document of the smallest doc_id stays.

    Where ids repeat, rows are numbered by id and hash of the text, and a group keeps its first row: a text that has no copy stays, whoever shares its id. Of rows that
    repeat an id and a text, one stays. Rows without an id stay.
    """
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return without(docs, simhash.copies(docs), "copies")
    named, back = aside(docs)
    rows = save(named.where("doc_id is not null").orderBy("doc_id", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    kept = without(rows.withColumnRenamed("doc_id", "_id").withColumnRenamed("_row", "doc_id"), simhash.copies(rows.select(F.col("_row").alias("doc_id"), "text")), "copies")
    kept = kept.drop("doc_id").withColumnRenamed("_id", "doc_id").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])
    return kept.select(*back).unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go; others stay as they are."""
    found = decontam.contamination(docs, read(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated").select("doc_id").distinct(), "contaminated")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids, what they decode to, and their number."""
    return bpe.encode(docs, vocabulary_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: SQL has neither zstandard nor trained classifiers; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
