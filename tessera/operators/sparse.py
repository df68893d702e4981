"""BM25 over an inverted index (R2-R5, A1-A3, S13). Query terms meet postings by an equi-join on the term.

index() is the postings table of a collection; kept as Parquet it serves searches, document frequencies, statistics and
re-ranking alike, and with_added() and without() keep it up when documents come and go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions import text as T


def term_counts(terms: Column) -> Column:
    """Array of (term, tf) of an array of terms: runs of the sorted array."""

    def runs(a):
        starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1) != x), F.struct(x.alias("term"), i.alias("at")))), lambda s: s.isNotNull())
        return T.let(starts, lambda s: F.transform(s, lambda p, j: F.struct(p["term"].alias("term"), (F.coalesce(F.get(s, j + 1)["at"], F.size(a)) - p["at"]).cast("long").alias("tf"))))

    # sort_array compares natively, array_sort by an interpreted function
    return T.let(F.sort_array(terms), runs)


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, len, term, tf: a document's postings, and a row with no term for the document itself. Nothing is shuffled."""
    terms = docs.select(F.col(key).alias("key"), T.bm25_terms(F.col(text)).alias("ts"))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    rows = terms.select("key", F.coalesce(F.size("ts"), F.lit(0)).alias("len"), F.explode(F.concat(itself, F.coalesce(term_counts(F.col("ts")), F.array().cast("array<struct<term:string,tf:bigint>>")))).alias("p"))
    return rows.select("key", "len", "p.term", "p.tf")


def postings(indexed: DataFrame) -> DataFrame:
    """key, len, term, tf; documents without terms have none."""
    return indexed.where(F.col("term").isNotNull())


def stats(indexed: DataFrame) -> DataFrame:
    """One row: n documents and avgdl."""
    if "df" in indexed.columns:
        return indexed.where(F.col("term").isNull()).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), (F.sum("total") / F.sum("df")).alias("avgdl"))
    return indexed.where(F.col("term").isNull()).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, df, total: of an index what weights need: in how many documents a term stands, and a row with no term for the number of documents and
    of their terms. Taken by stats(), frequencies() and term_weights() in place of an index."""
    words = docs.select(T.content_tokens(F.col(text)).alias("ws"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0).cast(pa.list_(pa.string()))
            coded = lists.flatten().dictionary_encode()
            sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            stems = pa.array([stemmed(w) for w in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
            number = stems.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(coded) else np.zeros(0, np.int64)
            n = max(1, len(stems.dictionary))
            own = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + number) % n
            df = np.bincount(own, minlength=len(stems.dictionary))
            held.append(pa.table({"term": pa.concat_arrays([stems.dictionary, pa.nulls(1, pa.string())]), "df": np.append(df, len(sizes)).astype(np.int64), "total": np.append(np.zeros(len(df), np.int64), sizes.sum())}))
            size += len(held[-1])
            if size > 1 << 20:
                held = [_summed(held)]
                size = len(held[0])
                if size > 1 << 19:
                    yield from held.pop().to_batches(1 << 14)
                    size = 0
        if held:
            yield from _summed(held).to_batches(1 << 14)

    partial = words.mapInArrow(run, "term string, df long, total long")
    return partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _summed(held: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(held).group_by("term").aggregate([("df", "sum"), ("total", "sum")])
    return pa.table({"term": t["term"], "df": t["df_sum"], "total": t["total_sum"]}).combine_chunks()


def stemmed(word: str) -> str:
    """T.stem() of one word."""
    return word[:-1] if len(word) > 4 and word.endswith("s") and not word.endswith("ss") else word


def frequencies(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df of those of terms (term) that documents have; indexed: an index, or counted()."""
    if "df" in indexed.columns:
        return indexed.join(terms.select("term").distinct(), "term", "left_semi").select("term", "df")
    return postings(indexed).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def without(indexed: DataFrame, keys: DataFrame) -> DataFrame:
    """The index with no postings of these keys (key)."""
    return indexed.join(keys.select("key"), "key", "left_anti")


def with_added(indexed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index with documents added, or replaced where their keys are in it; only their texts are tokenised."""
    return without(indexed, docs.select(F.col(key).alias("key"))).unionByName(index(docs, key, text))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, qid: str, text: str) -> DataFrame:
    """qid, term, times (a repeated term counts again)."""
    q = queries.select(F.col(qid).alias("qid"), F.explode(T.bm25_terms(F.col(text))).alias("term"))
    return q.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


def term_weights(indexed: DataFrame, queries: DataFrame, qid: str, question: str) -> tuple[DataFrame, float]:
    """qid, term, weight (idf times the term's count in the question), and avgdl."""
    terms = query_terms(queries, qid, question)
    df = frequencies(indexed, terms)
    n, avgdl = stats(indexed).first()
    return terms.join(df, "term").select("qid", "term", (F.col("times") * idf(F.lit(n), F.col("df"))).alias("weight")), avgdl or 1.0


def search(indexed: DataFrame, queries: DataFrame, qid: str, question: str, k: int, config=DEFAULT) -> DataFrame:
    """qid, key, sparse, sparse_rank (from 0): the k best by BM25 over an index; ties by key."""
    terms = query_terms(queries, qid, question)
    # only postings of terms that are asked for are counted and joined
    asked = postings(indexed).join(terms.select("term").distinct(), "term", "left_semi")
    df = asked.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats(indexed)))  # one row
    weights = weights.select("qid", "term", "times", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    k1, b = config.bm25_k1, config.bm25_b
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    scored = asked.join(weights, "term").groupBy("qid", "key").agg(F.round(F.sum(part), 6).alias("sparse")).where("sparse > 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sparse"), "key"))
    return scored.withColumn("sparse_rank", rank - 1).where(F.col("sparse_rank") < k)
