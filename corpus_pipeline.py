"""Corpus pipeline: reject toxic documents, keep one of each group of near copies, redact personal data, mix sources to
their weights, and pack what is left along a space-filling curve.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the shared
folder and reads it back for the next one, so a lost executor never costs an earlier stage. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import mixing, ngram_join, packing, pii, toxicity
from tessera.llm.common import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram similarity, the one with the least doc_id."""
    return ngram_join.first_of_each(docs)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; n_chars follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's target takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", keep_first_copies),
    ("pii", redact_personal),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Training, sampling and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
