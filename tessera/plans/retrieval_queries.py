"""Queries over sparse and dense retrieval, fusion, re-ranking, filtering and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..operators import dense as D, embedding as E, fusion, optimize as O, rerank, sparse as S
from ..shared import keep
from . import retriever
from .registry import n_tokens, norm, query, table, toks
from .text_queries import _PAIRS, _SYN, contained, content

STEM = "CASE WHEN length({t}) > 4 AND {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"
STEMMED = lambda x: f"list_transform({content(x)}, lambda z: {STEM.format(t='z')})"

POSTINGS = f"""
dt AS (SELECT doc_id AS key, {STEMMED('text')} AS ts FROM documents),
post AS (SELECT key, len, term, count(*) AS tf FROM (SELECT key, len(ts) AS len, unnest(ts) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt)"""
BM25 = f"""{POSTINGS},
qt AS (SELECT qid, term, count(*) AS times FROM (SELECT item_id AS qid, unnest({STEMMED('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, key, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / avgdl))), 6) AS sparse
 FROM post JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL HAVING round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / avgdl))), 6) > 0),
br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sparse DESC, key) - 1 AS sparse_rank FROM bm)"""


def embed_sql(name: str, source: str, key: str, dim: int = 64, grams: tuple[int, ...] = ()) -> str:
    """CTEs that end in {name}(key, bucket, v)."""
    chars = "".join(f" UNION ALL SELECT key, 'c{n}:' || substr('<' || x || '>', i, {n}), 0.25 FROM (SELECT key, x, unnest(range(1, length(x) + 2 - {n} + 2)) AS i FROM {name}x)" for n in grams)
    return f"""
{name}w AS (SELECT {key} AS key, {content('text')} AS ws FROM {source}),
{name}x AS (SELECT key, unnest(ws) AS x FROM {name}w),
{name}s AS (SELECT key, unnest(syns) AS x FROM {name}x JOIN {_SYN} ON term = x),
{name}f AS (SELECT key, 'w:' || x AS f, 1.0 AS w FROM {name}x UNION ALL SELECT key, 's:' || x[:6], 0.6 FROM {name}x
 UNION ALL SELECT key, 'w:' || x, 0.35 FROM {name}s UNION ALL SELECT key, 's:' || x[:6], 0.25 FROM {name}s
 UNION ALL SELECT key, 'b:' || ws[i] || '_' || ws[i + 1], 0.8 FROM (SELECT key, ws, unnest(range(1, len(ws))) AS i FROM {name}w){chars}),
{name}t AS (SELECT key, f, round(sum(w)::DOUBLE, 6) AS tf FROM {name}f GROUP BY ALL),
{name}b AS (SELECT key, ('0x' || substr(md5(f), 1, 8))::UBIGINT % {dim} AS bucket, sum(CASE WHEN ('0x' || substr(md5(f), 9, 1))::INT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0 END * CASE WHEN tf >= 1 THEN 1 + ln(tf) ELSE tf END) AS v FROM {name}t GROUP BY ALL),
{name} AS (SELECT key, bucket, coalesce(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY key)), 0), 0) AS v FROM {name}b)"""


POOL = f"""{BM25},{embed_sql('dv', 'documents', 'doc_id')},{embed_sql('qv', 'benchmark', 'item_id')},
sim AS (SELECT q.key AS qid, d.key, round(sum(q.v * d.v), 6) AS dense FROM qv q JOIN dv d USING (bucket) GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, key) - 1 AS dense_rank FROM sim),
pool AS (SELECT qid, key, coalesce(s.dense, 0) AS dense, dense_rank, coalesce(sparse, 0) AS sparse, sparse_rank, round(coalesce(1 / (60 + dense_rank + 1), 0) + coalesce(1 / (60 + sparse_rank + 1), 0), 9) AS fused
 FROM (SELECT qid, key, dense_rank FROM dr WHERE dense_rank < 20) a FULL JOIN (SELECT qid, key, sparse, sparse_rank FROM br WHERE sparse_rank < 20) b USING (qid, key) LEFT JOIN sim s USING (qid, key)),
cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, key) - 1 AS fused_rank FROM pool QUALIFY fused_rank < 24)"""


def ranked_sql(use_sparse: bool = True, blend: str = "cross", join: str = "") -> str:
    w = rerank.weights(use_sparse)
    return f"""{POOL},
qw AS (SELECT qid, pos, term, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS idf, list_distinct([term, term[:5]] || coalesce(syns, []) || list_transform(coalesce(syns, []), lambda x: x[:5])) AS words
 FROM (SELECT item_id AS qid, generate_subscripts({content('text')}, 1) AS pos, unnest({content('text')}) AS term FROM benchmark) LEFT JOIN {_SYN} USING (term) LEFT JOIN (SELECT term AS t2, df FROM df) ON t2 = {STEM.format(t='term')}, st),
ps AS (SELECT doc_id AS key, list_distinct({toks("source || ' | ' || lang || chr(10) || text")}) AS own, {toks("lang || ' ' || source")} AS head FROM documents WHERE doc_id IN (SELECT key FROM cut)),
cov AS (SELECT qid, key, sum(idf) AS total, sum(CASE WHEN list_has_any(words, own) OR list_has_any(words, list_transform(own, lambda x: x[:5])) THEN idf ELSE 0 END) AS met, max(CASE WHEN list_has_any(words, head) THEN 1.0 ELSE 0.0 END) AS heading FROM cut JOIN ps USING (key) JOIN qw USING (qid) GROUP BY ALL),
sc AS (SELECT cut.*, coalesce(heading, 0)::DOUBLE AS heading, round(coalesce(met / nullif(total, 0), 0), 3) AS coverage,
 round({w['dense']}::DOUBLE * least(1.0, greatest(0.0, (dense - 0.05::DOUBLE) / 0.45)) + {w['sparse']}::DOUBLE * sparse / coalesce(nullif(max(sparse) OVER (PARTITION BY qid), 0), 1) + {w['coverage']}::DOUBLE * coalesce(met / nullif(total, 0), 0) + {w['heading']}::DOUBLE * coalesce(heading, 0), 6) AS cross_s
 FROM cut LEFT JOIN cov USING (qid, key)),
bl AS (SELECT sc.*, {blend.replace('cross', 'cross_s')} AS rerank FROM sc {join}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, fused_rank) - 1 AS rank FROM bl QUALIFY rank < 12)"""


RANKED = ranked_sql()
FLOOR = "fl AS (SELECT * FROM (SELECT *, max(rerank) OVER (PARTITION BY qid) AS top FROM ranked) WHERE rerank >= greatest(0.2, 0.5 * top) AND coverage <> 0)"
FINAL = f"{FLOOR}, fin AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, fused_rank) AS final_rank FROM fl QUALIFY final_rank <= 4)"


#: The embedder that the SQL twins fix: 64 buckets by md5, no character n-grams. Queries without a twin use that of Config.
TWIN = {"embed": E.md5_embed}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")


@query("term_frequency", f"WITH {POSTINGS} SELECT term, sum(tf)::BIGINT AS total, max(tf) AS most FROM post GROUP BY term")
def term_frequency(spark, sf_dir):
    p = S.postings(S.index(table(spark, sf_dir, "documents")))
    return p.groupBy("term").agg(F.sum("tf").alias("total"), F.max("tf").alias("most"))


@query("doc_frequency", f"WITH {POSTINGS} SELECT term, df FROM df")
def doc_frequency(spark, sf_dir):
    return S.postings(S.index(table(spark, sf_dir, "documents"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("doc_length_stats", f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def doc_length_stats(spark, sf_dir):
    return S.stats(S.index(table(spark, sf_dir, "documents"))).select("n", F.round("avgdl", 6).alias("avgdl"))


@query("idf_table", f"WITH {POSTINGS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def idf_table(spark, sf_dir):
    indexed = keep(S.index(table(spark, sf_dir, "documents")), "postings")
    df = S.postings(indexed).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(S.stats(indexed))).select("term", F.round(S.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_KEPT = POSTINGS.replace("FROM documents)", "FROM documents WHERE lang = 'de' OR doc_id % 10 <> 0)", 1)


@query("index_upkeep", f"WITH {_KEPT} SELECT term, df, n, round(avgdl, 6) AS avgdl FROM df, st")
def index_upkeep(spark, sf_dir):
    """An index of the other languages, less every tenth document, with the German ones added; only these are tokenised for it."""
    docs = table(spark, sf_dir, "documents")
    old = keep(S.index(docs.where("lang != 'de' OR lang IS NULL")), "postings")
    now = keep(S.with_added(S.without(old, docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("key"))), docs.where("lang = 'de'")), "postings")
    df = S.postings(now).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(S.stats(now))).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))  # one row


@query("bm25_topk", f"WITH {BM25} SELECT qid, key, sparse, sparse_rank::INT AS sparse_rank FROM br WHERE sparse_rank < 5")
def bm25_topk(spark, sf_dir):
    docs, q = _docs(spark, sf_dir)
    return S.search(keep(S.index(docs), "postings"), q, "item_id", "text", 5)


@query("md5_embed_docs", f"WITH {embed_sql('dv', 'documents', 'doc_id', 128, E.GRAMS)} SELECT key, bucket::BIGINT AS bucket, round(v, 6) + 0 AS v FROM dv")
def md5_embed_docs(spark, sf_dir):
    """C6-C8 with character n-grams, as rows of buckets."""
    rows = E.md5_bucket_rows(table(spark, sf_dir, "documents"), "doc_id", "text", 128, E.GRAMS)
    return rows.select("key", "bucket", (F.round("v", 6) + 0.0).alias("v"))


@query("hash_embed_docs")
def hash_embed_docs(spark, sf_dir):
    return E.hash_embed(table(spark, sf_dir, "documents"))


_DOT = "round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


@query("dense_topk", f"SELECT q.vec_id AS qid, v.vec_id AS key, {_DOT} AS dense, (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id) - 1)::INT AS dense_rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY dense_rank < 20")
def dense_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query against all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return D.top_k(v, v.where("vec_id % 20 = 0"), 20, "vec_id", "embedding", "vec_id", "embedding")


@query("dense_topk_per_label", f"SELECT q.vec_id AS qid, v.label, v.vec_id AS key, {_DOT} AS dense FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY {_DOT} DESC, v.vec_id) <= 2")
def dense_topk_per_label(spark, sf_dir):
    """The two nearest vectors of each label."""
    v = table(spark, sf_dir, "embeddings")
    return D.top_k(v, v.where("vec_id % 20 = 0"), 2, "vec_id", "embedding", "vec_id", "embedding", by="label").select("qid", "label", "key", "dense")


@query("near_dup_pairs", f"SELECT q.vec_id AS a, v.vec_id AS b, {_DOT} AS cosine FROM embeddings q, embeddings v WHERE q.vec_id < v.vec_id AND {_DOT} >= 0.35")
def near_dup_pairs(spark, sf_dir):
    """J8 at a threshold that these vectors reach."""
    return D.pairs_above(table(spark, sf_dir, "embeddings"), 0.35, "vec_id", "embedding")


@query("rrf_fusion", f"WITH {POOL} SELECT qid, key, dense, coalesce(dense_rank, -1)::INT AS dense_rank, sparse, coalesce(sparse_rank, -1)::INT AS sparse_rank, fused, fused_rank::INT AS fused_rank FROM cut")
def rrf_fusion(spark, sf_dir):
    """R6-R8."""
    docs, q = _docs(spark, sf_dir)
    rank = lambda c: F.coalesce(c, F.lit(-1)).alias(c)  # noqa: E731  -1: not found by it
    return retriever.candidates(docs, q, **TWIN).select("qid", "key", "dense", rank("dense_rank"), "sparse", rank("sparse_rank"), "fused", "fused_rank")


def _ranked(spark, sf_dir, **kw) -> DataFrame:
    docs, q = _docs(spark, sf_dir)
    return retriever.retrieve(docs, q, **(TWIN | kw))


@query("cross_feature_rerank", f"WITH {RANKED} SELECT qid, key, rank::INT AS rank, rerank, coverage, heading FROM ranked")
def cross_feature_rerank(spark, sf_dir):
    """R9, R13."""
    return _ranked(spark, sf_dir).select("qid", "key", "rank", "rerank", "coverage", "heading")


@query("rerank_no_sparse", f"WITH {ranked_sql(False)} SELECT qid, key, rank::INT AS rank, rerank FROM ranked")
def rerank_no_sparse(spark, sf_dir):
    """R10."""
    return _ranked(spark, sf_dir, use_sparse=False).select("qid", "key", "rank", "rerank")


_LLM_JOIN = "LEFT JOIN (SELECT doc_id, max(quality)::DOUBLE AS llm FROM labels GROUP BY doc_id) l ON l.doc_id = key"


@query("llm_blend_stub", f"WITH {ranked_sql(True, 'round(CASE WHEN llm IS NOT NULL AND fused_rank < 12 THEN 0.7 * llm + 0.3 * cross ELSE cross END, 8)', _LLM_JOIN)} SELECT qid, key, rank::INT AS rank, rerank FROM ranked")
def llm_blend_stub(spark, sf_dir):
    """R11 with labels.quality in place of a model's scores."""
    docs, q = _docs(spark, sf_dir)
    quality = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.max("quality").cast("double").alias("llm"))
    return retriever.retrieve(docs, q, llm=quality, **TWIN).select("qid", "key", "rank", "rerank")


@query("prior_blend", f"WITH {ranked_sql(True, 'round(cross * (0.75 + 0.25 * (1.0 / (1 + key % 7))), 8)')} SELECT qid, key, rank::INT AS rank, rerank FROM ranked")
def prior_blend(spark, sf_dir):
    """A prior made from the key scales the score."""
    docs, q = _docs(spark, sf_dir)
    return retriever.retrieve(docs, q, prior=1.0 / (1 + F.col("key") % 7), **TWIN).select("qid", "key", "rank", "rerank")


@query("relevance_floor_filter", f"WITH {RANKED}, {FLOOR} SELECT qid, key, rerank FROM fl")
def relevance_floor_filter(spark, sf_dir):
    """F1."""
    return O.relevance_floor(_ranked(spark, sf_dir)).select("qid", "key", "rerank")


@query("hybrid_topk", f"WITH {RANKED}, {FINAL} SELECT qid, key, final_rank::INT AS final_rank, rerank, fused, dense, sparse, coverage FROM fin")
def hybrid_topk(spark, sf_dir):
    """Flagship: hybrid retrieval, re-ranking, floor and final cut for all questions."""
    kept = O.final_select(O.relevance_floor(_ranked(spark, sf_dir)), DEFAULT.final_k)
    return kept.select("qid", "key", "final_rank", "rerank", "fused", "dense", "sparse", "coverage")


@query("final_select", f"WITH {RANKED}, {FLOOR} SELECT qid, least(4, count(*))::BIGINT AS kept, greatest(0, count(*) - 4)::BIGINT AS dropped_by_k FROM fl GROUP BY qid")
def final_select(spark, sf_dir):
    """K3."""
    n = F.count(F.lit(1))
    return O.relevance_floor(_ranked(spark, sf_dir)).groupBy("qid").agg(F.least(F.lit(4), n).alias("kept"), F.greatest(F.lit(0), n - 4).alias("dropped_by_k"))


@query("budget_prefix_drop", f"WITH {RANKED}, {FINAL}, run AS (SELECT qid, key, final_rank, sum({n_tokens('text')}) OVER (PARTITION BY qid ORDER BY final_rank) AS used FROM fin JOIN documents ON doc_id = key) SELECT qid, key, used::BIGINT AS used FROM run WHERE used <= 700")
def budget_prefix_drop(spark, sf_dir):
    """The best items whose tokens fit 700."""
    docs, _ = _docs(spark, sf_dir)
    kept = O.final_select(O.relevance_floor(_ranked(spark, sf_dir)), DEFAULT.final_k).join(docs.select(F.col("doc_id").alias("key"), "text"), "key")
    return O.budget_prefix(kept, "text", "final_rank", 700).select("qid", "key", F.col("used").cast("long").alias("used"))


@query("already_loaded_exclusion", f"WITH {RANKED}, l AS (SELECT DISTINCT substr(sha1({norm('text')}), 1, 16) AS h FROM documents WHERE lang = 'de') SELECT qid, key, rank::INT AS rank FROM ranked JOIN documents ON doc_id = key WHERE substr(sha1({norm('text')}), 1, 16) NOT IN (SELECT h FROM l)")
def already_loaded_exclusion(spark, sf_dir):
    """candidates whose content is loaded already are left out (here: all German documents)."""
    docs, _ = _docs(spark, sf_dir)
    hashed = docs.select(F.col("doc_id").alias("key"), "lang", T.content_hash(F.col("text")).alias("h"))
    loaded = hashed.where("lang = 'de'").select("h").distinct()
    ranked = _ranked(spark, sf_dir).join(hashed.select("key", "h"), "key")
    return ranked.join(loaded, "h", "left_anti").select("qid", "key", "rank")


@query("citation_tags", f"WITH {RANKED}, {FINAL} SELECT qid, '[S' || final_rank || '] (' || source || ' § ' || lang || ')' AS tag, round(rerank, 3) AS score FROM fin JOIN documents ON doc_id = key")
def citation_tags(spark, sf_dir):
    """Tags of the sources of each question."""
    docs, _ = _docs(spark, sf_dir)
    kept = O.final_select(O.relevance_floor(_ranked(spark, sf_dir)), DEFAULT.final_k).join(docs.select(F.col("doc_id").alias("key"), "source", "lang"), "key")
    tag = F.concat(F.lit("[S"), F.col("final_rank").cast("string"), F.lit("] ("), T.citation(F.col("source"), F.col("lang")), F.lit(")"))
    return kept.select("qid", tag.alias("tag"), F.round("rerank", 3).alias("score"))


_CONV = f"""
ct AS (SELECT conv_id * 1000 + turn AS key, {STEMMED('text')} AS ts FROM conversations),
cpost AS (SELECT key, len, term, count(*) AS tf FROM (SELECT key, len(ts) AS len, unnest(ts) AS term FROM ct) GROUP BY ALL),
cdf AS (SELECT term, count(*) AS df FROM cpost GROUP BY term), cst AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM ct),
cbm AS (SELECT qid, key, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / avgdl))), 6) AS sparse FROM cpost JOIN cdf USING (term) JOIN qt USING (term), cst GROUP BY ALL),
cr AS (SELECT 'conversations' AS collection, *, row_number() OVER (PARTITION BY qid ORDER BY sparse DESC, key) - 1 AS r FROM cbm WHERE sparse > 0 QUALIFY r < 20)"""


@query("collection_union_topk", f"WITH {BM25}, {_CONV}, u AS (SELECT collection, qid, key, r FROM cr UNION ALL SELECT 'documents', qid, key, sparse_rank FROM br WHERE sparse_rank < 20) SELECT qid, collection, key, round(1 / (61 + r), 9) AS fused FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY r, collection, key) <= 24")
def collection_union_topk(spark, sf_dir):
    """Two collections searched apart, then cut together."""
    docs, q = _docs(spark, sf_dir)
    talk = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    one = lambda d, name: S.search(keep(S.index(d), "postings"), q, "item_id", "text", DEFAULT.sparse_k).withColumn("collection", F.lit(name))
    both = one(docs, "documents").unionByName(one(talk, "conversations"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("sparse_rank", "collection", "key"))
    return both.withColumn("r", rank).where("r <= 24").select("qid", "collection", "key", F.round(1 / (61 + F.col("sparse_rank")), 9).alias("fused"))


_GOLD = _PAIRS.strip().removeprefix("WITH ") + ", gold AS (SELECT item_id AS qid, doc_id AS key FROM p WHERE common >= 0.85 * nb), asked AS (SELECT DISTINCT qid FROM gold)"
_MODES = "modes AS (SELECT 'dense' AS mode, qid, key, dense_rank AS r FROM dr WHERE dense_rank < 5 UNION ALL SELECT 'bm25', qid, key, sparse_rank FROM br WHERE sparse_rank < 5 UNION ALL SELECT 'rrf', qid, key, fused_rank FROM cut WHERE fused_rank < 5 UNION ALL SELECT 'rerank', qid, key, rank FROM ranked WHERE rank < 5)"
_METRIC = """hits AS (SELECT mode, a.qid, r, g.key IS NOT NULL AS rel FROM (SELECT DISTINCT mode FROM modes) CROSS JOIN asked a LEFT JOIN modes m USING (mode, qid) LEFT JOIN gold g ON g.qid = a.qid AND g.key = m.key),
per AS (SELECT mode, qid, max((rel AND r < 1)::INT) AS h1, max((rel AND r < 3)::INT) AS h3, max(rel::INT) AS h5, coalesce(1 / (min(r) FILTER (rel) + 1), 0) AS rr, coalesce(sum(1 / log2(r + 2)) FILTER (rel), 0) AS dcg, count(*) FILTER (rel) AS n FROM hits GROUP BY ALL)
SELECT mode, round(avg(h1), 3) AS hit1, round(avg(h3), 3) AS hit3, round(avg(h5), 3) AS recall5, round(avg(rr), 3) AS mrr,
 round(avg(dcg / CASE n WHEN 0 THEN 1 ELSE list_sum(list_transform(range(0, n), lambda i: 1 / log2(i + 2))) END), 3) AS ndcg5 FROM per GROUP BY mode"""


def rank_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """E-1 by mode: ranked (mode, qid, key, r from 0 to 4) against gold (qid, key), over the questions that have gold."""
    asked = gold.select("qid").distinct().crossJoin(F.broadcast(ranked.select("mode").distinct()))  # a row a mode
    rel = asked.join(ranked, ["mode", "qid"], "left").join(gold.withColumn("rel", F.lit(True)), ["qid", "key"], "left").withColumn("rel", F.coalesce("rel", F.lit(False)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    hit = lambda k: F.max((F.col("rel") & (F.col("r") < k)).cast("int"))
    per = rel.groupBy("mode", "qid").agg(hit(1).alias("h1"), hit(3).alias("h3"), hit(5).alias("h5"), F.min(F.when(F.col("rel"), F.col("r"))).alias("first"), F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("r") + 2.0))).alias("dcg"), F.sum(F.col("rel").cast("int")).alias("n"))
    mean = lambda c: F.round(F.avg(c), 3)
    return per.groupBy("mode").agg(mean("h1").alias("hit1"), mean("h3").alias("hit3"), mean("h5").alias("recall5"), mean(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"), mean(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0)).alias("ndcg5"))


def gold_pairs(spark, sf_dir) -> DataFrame:
    """F8: a document is relevant for an item that it contains almost whole."""
    return contained(spark, sf_dir).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("key"))


@query("retrieval_metrics", f"WITH {_GOLD}, {BM25}, modes AS (SELECT 'bm25' AS mode, qid, key, sparse_rank AS r FROM br WHERE sparse_rank < 5), {_METRIC}")
def retrieval_metrics(spark, sf_dir):
    """E-1 for BM25."""
    return rank_metrics(bm25_topk(spark, sf_dir).select(F.lit("bm25").alias("mode"), "qid", "key", F.col("sparse_rank").alias("r")), gold_pairs(spark, sf_dir))


_VARIANTS = f"benchmark AS (SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: i % 3 <> 0), lambda i: ws[i]), ' ') FROM (SELECT item_id, {content('text')} AS ws FROM benchmark))"
_SOURCES = "s AS (SELECT qid // 2 AS item, qid % 2 AS variant, list(key ORDER BY sparse_rank) AS keys FROM br WHERE sparse_rank < 5 GROUP BY ALL)"


@query("source_consistency", f"WITH {_VARIANTS}, {BM25.strip()}, {_SOURCES} SELECT count(*) AS pairs, round(avg(len(list_intersect(a.keys, b.keys)) / len(list_distinct(a.keys || b.keys))), 6) AS source_jaccard, round(avg((a.keys[1] = b.keys[1])::INT), 3) AS same_best FROM s a JOIN s b ON a.item = b.item AND a.variant = 0 AND b.variant = 1")
def source_consistency(spark, sf_dir):
    """E-7, A12: sources of each question and of a paraphrase that has two of every three content words."""
    docs, q = _docs(spark, sf_dir)
    part = F.array_join(F.filter(T.content_tokens(F.col("text")), lambda w, i: (i + 1) % 3 != 0), " ")
    asked = q.select((F.col("item_id") * 2).alias("item_id"), "text").unionByName(q.select((F.col("item_id") * 2 + 1).alias("item_id"), part.alias("text")))
    found = S.search(keep(S.index(docs), "postings"), asked, "item_id", "text", 5)
    s = found.groupBy(F.floor(F.col("qid") / 2).alias("item"), (F.col("qid") % 2).alias("variant")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sparse_rank", "key"))), lambda x: x["key"]).alias("keys"))
    both = s.where("variant = 0").select("item", F.col("keys").alias("a")).join(s.where("variant = 1").select("item", F.col("keys").alias("b")), "item")
    return both.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))), 6).alias("source_jaccard"), F.round(F.avg((F.get("a", F.lit(0)) == F.get("b", F.lit(0))).cast("int")), 3).alias("same_best"))


@query("ablation_by_mode", f"WITH {_GOLD}, {RANKED}, {_MODES}, {_METRIC}")
def ablation_by_mode(spark, sf_dir):
    """E-2."""
    docs, q = _docs(spark, sf_dir)
    # one pool has the nearest and the lexically best of each question: documents are tokenised and embedded once
    indexed = keep(S.index(docs), "postings")
    pool = keep(fusion.pool(docs, q, "item_id", "text", indexed=indexed, **TWIN), "pool")
    cands = keep(fusion.cut_pool(pool, 2 * DEFAULT.rerank_top_n), "candidates")
    ranked = retriever.retrieve(docs, q, indexed=indexed, cands=cands)
    pick = lambda d, mode, r: d.select(F.lit(mode).alias("mode"), "qid", "key", F.col(r).alias("r")).where("r < 5")
    modes = pick(pool, "dense", "dense_rank").unionByName(pick(pool, "bm25", "sparse_rank")).unionByName(pick(cands, "rrf", "fused_rank")).unionByName(pick(ranked, "rerank", "rank"))
    return rank_metrics(modes, gold_pairs(spark, sf_dir))


@query("filter_calibration", f"WITH {_GOLD}, {RANKED} SELECT round(avg((rerank >= 0.2)::INT) FILTER (g.key IS NOT NULL), 3) AS gold_kept, round(avg((rerank < 0.2)::INT) FILTER (g.key IS NULL), 3) AS other_filtered, round(avg(rerank) FILTER (g.key IS NOT NULL), 3) AS gold_score, round(avg(rerank) FILTER (g.key IS NULL), 3) AS other_score FROM ranked r LEFT JOIN gold g ON g.qid = r.qid AND g.key = r.key")
def filter_calibration(spark, sf_dir):
    """E-5."""
    x = _ranked(spark, sf_dir).select("qid", "key", "rerank").join(gold_pairs(spark, sf_dir).withColumn("g", F.lit(True)), ["qid", "key"], "left")
    g = F.col("g").isNotNull()
    mean = lambda c, cond: F.round(F.avg(F.when(cond, c)), 3)
    return x.agg(mean((F.col("rerank") >= 0.2).cast("int"), g).alias("gold_kept"), mean((F.col("rerank") < 0.2).cast("int"), ~g).alias("other_filtered"), mean(F.col("rerank"), g).alias("gold_score"), mean(F.col("rerank"), ~g).alias("other_score"))


def _items(spark, sf_dir) -> DataFrame:
    docs, q = _docs(spark, sf_dir)
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    asked = q.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return retriever.retrieve(docs, q).select("qid", "key", "rerank", "coverage").join(texts, "key").join(asked, "qid")


@query("greedy_dedup")
def greedy_dedup(spark, sf_dir):
    """O1-O3 on the re-ranked list of every question."""
    return O.dedup(_items(spark, sf_dir)).select("qid", "key", "rerank", "kept", "reason")


@query("optimise_pipeline")
def optimise_pipeline(spark, sf_dir):
    """O5 with a report for each question."""
    return O.optimise(_items(spark, sf_dir)).select("qid", *O.REPORT)


@query("context_metrics")
def context_metrics(spark, sf_dir):
    """E-3: precision and token reduction of optimised contexts."""
    rows = O.optimise(_items(spark, sf_dir), rows=True)
    gold = gold_pairs(spark, sf_dir).withColumn("g", F.lit(1))
    per = rows.join(gold, ["qid", "key"], "left").groupBy("qid").agg(F.avg(F.coalesce("g", F.lit(0))).alias("precision"), F.max(F.coalesce("g", F.lit(0))).alias("support"), F.sum("tokens").alias("tokens"))
    return per.agg(F.round(F.avg("precision"), 3).alias("context_precision"), F.round(F.avg("support"), 3).alias("support"), F.round(F.avg("tokens"), 1).alias("tokens_after"), F.count(F.lit(1)).alias("questions"))


@query("optimiser_ablation")
def optimiser_ablation(spark, sf_dir):
    """E-4: the same with stages switched off, one row a variant."""
    items, gold = keep(_items(spark, sf_dir), "items"), keep(gold_pairs(spark, sf_dir).withColumn("g", F.lit(1)), "gold")
    variants = {"raw": dict(min_relevance=0.0, relative_floor=0.0, near=False), "absolute floor": dict(relative_floor=0.0, near=False), "relative floor": dict(near=False), "dedup": {}}
    out = None
    for name, kw in variants.items():
        per = O.optimise(items, rows=True, **kw).join(gold, ["qid", "key"], "left").groupBy("qid").agg(F.avg(F.coalesce("g", F.lit(0))).alias("p"), F.max(F.coalesce("g", F.lit(0))).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
        row = per.agg(F.lit(name).alias("variant"), F.round(F.avg("p"), 3).alias("context_precision"), F.round(F.avg("s"), 3).alias("support"), F.round(F.avg("n"), 3).alias("items_after"), F.round(F.avg("t"), 1).alias("tokens"))
        out = row if out is None else out.unionByName(row)
    return out
