"""Hybrid retrieval for a batch of questions at once, from first stage to the ranked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import fusion, rerank, sparse
from ..shared import keep


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str = "source", section: str = "lang") -> DataFrame:
    """key, title, section, text, body of a collection."""
    t, s, x = F.col(title), F.col(section), F.col(text)
    return docs.select(F.col(key).alias("key"), t.alias("title"), s.alias("section"), x.alias("text"), T.embed_text(t, s, x).alias("body"))


def candidates(docs: DataFrame, queries: DataFrame, qid: str = "item_id", question: str = "text", config=DEFAULT, **kw) -> DataFrame:
    return fusion.cut_pool(fusion.pool(docs, queries, qid, question, config=config, **kw), 2 * config.rerank_top_n)


def retrieve(docs: DataFrame, queries: DataFrame, qid: str = "item_id", question: str = "text", config=DEFAULT, use_sparse: bool = True, llm: DataFrame | None = None, prior: Column | None = None, indexed: DataFrame | None = None, cands: DataFrame | None = None, **kw) -> DataFrame:
    """qid, key, rank, rerank, cross, coverage and the signals behind them: rerank_top_n rows a question. indexed: the postings of docs, and
    cands: the candidates, each made here if not given."""
    indexed = indexed if indexed is not None else keep(sparse.index(docs), "postings")
    cands = cands if cands is not None else keep(candidates(docs, queries, qid, question, config, indexed=indexed, **kw), "candidates")
    scored = rerank.score(cands, rerank.query_profile(indexed, queries, qid, question), passages(docs), use_sparse)
    return rerank.best(rerank.blend(scored, llm, prior, config.rerank_top_n), config.rerank_top_n)
