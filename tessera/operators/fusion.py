"""Hybrid pool and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..shared import keep
from . import both as B, dense as D, embedding as E, sparse as S


def _separate(docs: DataFrame, queries: DataFrame, qid: str, question: str, key: str, text: str, embed, config, indexed: DataFrame) -> DataFrame:
    """What both searches find, for embedders whose vectors are a table."""
    asked = keep(embed(queries, qid, question).withColumnRenamed("key", "qid"), "asked")
    near = keep(D.top_k(embed(docs, key, text), asked, config.dense_k), "near")
    lexical = keep(S.search(indexed, queries, qid, question, config.sparse_k, config), "lexical")
    both = near.join(lexical, ["qid", "key"], "full")
    # keys that only BM25 found need their vectors: a few documents a question are embedded for it
    alone = lexical.join(near, ["qid", "key"], "left_anti").select("qid", "key")
    late = embed(docs.join(alone.select(F.col("key").alias(key)).distinct(), key, "left_semi"), key, text)
    lacking = alone.join(late, "key").join(asked.withColumnRenamed("embedding", "q"), "qid")
    lacking = lacking.select("qid", "key", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("late"))
    return both.join(lacking, ["qid", "key"], "left")


def pool(docs: DataFrame, queries: DataFrame, qid: str, question: str, key: str = "doc_id", text: str = "text", embed=None, config=DEFAULT, indexed: DataFrame | None = None) -> DataFrame:
    """qid, key, dense, dense_rank, sparse, sparse_rank, fused; keys that only BM25 found get their true cosine. The embedder is
    that of config unless one is given; indexed: the postings of docs (for the hashing embedder, which shares one
    pass over docs with BM25, their counts too), made here if not given."""
    hashing = embed is None and config.embedder == "hashing"
    indexed = indexed if indexed is not None else keep(S.counted(docs, text) if hashing else S.index(docs, key, text), "postings")
    if hashing:
        met = B.search(docs, queries, qid, question, indexed, key, text, config)
        rank = F.row_number().over(Window.partitionBy("qid", "by").orderBy(F.desc("score"), "key")) - 1
        best = met.withColumn("r", rank).where(F.col("r") < F.when(F.col("by") == "d", config.dense_k).otherwise(config.sparse_k))
        of = lambda by, c: F.max(F.when(F.col("by") == by, F.col(c)))
        both = best.groupBy("qid", "key").agg(F.max("dense").alias("dense"), of("d", "r").alias("dense_rank"), of("s", "score").alias("sparse"), of("s", "r").alias("sparse_rank")).withColumn("late", F.lit(None).cast("double"))
    else:
        embed = embed or E.Embedder(config.embedder, config.embed_dim).embed
        both = _separate(docs, queries, qid, question, key, text, embed, config, indexed)
    share = lambda r: F.coalesce(1 / (config.rrf_k + F.col(r) + 1), F.lit(0.0))
    return both.select("qid", "key", F.coalesce("dense", "late", F.lit(0.0)).alias("dense"), "dense_rank", F.coalesce("sparse", F.lit(0.0)).alias("sparse"), "sparse_rank", F.round(share("dense_rank") + share("sparse_rank"), 9).alias("fused"))


def fused_order() -> list:
    """Best fusion first; ties by dense rank, then sparse rank, then key."""
    return [F.desc("fused"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("key")]


def cut_pool(pooled: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """The best of each query's pool, over all collections; fused_rank from 0."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*fused_order(), *(by or [])))
    return pooled.withColumn("fused_rank", rank - 1).where(F.col("fused_rank") < most)
