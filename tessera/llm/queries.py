"""The registered queries of this package; oracle SQL stands where SQL can express the result on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def op1_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_join(spark, sf_dir):
    from .ngram_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    from .pii import detect, digest

    return digest(detect(table(spark, sf_dir, "documents"), keep=["doc_id"]))


def op4_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license(spark, sf_dir):
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_quality(spark, sf_dir):
    from .quality import quality

    keep = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(table(spark, sf_dir, "documents")).select(*keep)


def op7_token_ids(spark, sf_dir):
    from .token_files import token_output

    return token_output(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_packing(spark, sf_dir):
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents")).drop("row")


def op10_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
