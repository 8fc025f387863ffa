"""Corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined cases: a null or empty text fails the base rules and goes in the first
stage, so does a text of fewer than twenty words; documents with a null id are
judged by the quality rules, cannot be linked or reported and so stay in the two
stages after it, and are not packed, for a piece names its document. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenewright.llm import lines, minhash, packing, pii, winnow
from scenewright.llm.corpus import stored, table
from scenewright.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without their failing lines."""
    kept = lines.clean_lines(docs, into="_cleaning").where("_cleaning.kept")
    return (kept.withColumn("text", F.col("_cleaning.clean_text")).withColumn("n_chars", F.length("text").cast("long"))
            .select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked at five words and 0.8."""
    found = minhash.near_duplicates(docs, k=5, percent=80)
    # copies of one row are one document: the id alone decides
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = winnow.contamination(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return pii.replace_entities(docs).select(docs.columns).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("replace_pii", replace_pii), ("pack", pack)]

#: Tokenizer, hashes and SHA-512 draws have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
