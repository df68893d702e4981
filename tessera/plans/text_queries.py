"""Queries over scalar text functions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text as T
from ..functions.words import STOPWORDS, SYNONYMS
from .registry import n_tokens, n_words, norm, query, quoted, sents, table, toks

STOP = quoted(STOPWORDS)
CONTENT = f"list_filter({{t}}, lambda w: w NOT IN {STOP})"


def content(x: str) -> str:
    return CONTENT.format(t=toks(x))


@query("tokenize_docs", f"SELECT doc_id, len({toks('text')})::INT AS n_tokens, md5(array_to_string({toks('text')}, ' ')) AS tokens_md5, len({content('text')})::INT AS n_content, md5(array_to_string({content('text')}, ' ')) AS content_md5 FROM documents")
def tokenize_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    d = d.withColumn("c", F.filter("t", lambda w: ~w.isin(*STOPWORDS)))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size("c").alias("n_content"), F.md5(F.array_join("c", " ")).alias("content_md5"))


@query("token_count_docs", f"SELECT doc_id, {n_tokens('text')} AS tokens FROM documents")
def token_count_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("tokens"))


@query("sentence_split", f"SELECT doc_id, len({sents('text')})::INT AS n_sentences, md5(array_to_string({sents('text')}, '|')) AS sentences_md5 FROM documents")
def sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("normalised_hash", f"SELECT doc_id, substr(sha1({norm('text')}), 1, 16) AS content_hash FROM documents")
def normalised_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("exact_dup_groups", f"SELECT substr(sha1({norm('text')}), 1, 16) AS content_hash, min(doc_id) AS keeper, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    """K7: the first document of each content hash; a pre-aggregated group, whatever its size."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


_PAIRS = f"""
WITH b AS (SELECT item_id, list_distinct({content('text')}) AS ws FROM benchmark), d AS (SELECT doc_id, list_distinct({content('text')}) AS ws FROM documents),
bw AS (SELECT item_id, len(ws) AS nb, unnest(ws) AS w FROM b), dw AS (SELECT doc_id, len(ws) AS nd, unnest(ws) AS w FROM d),
p AS (SELECT item_id, doc_id, any_value(nb) AS nb, any_value(nd) AS nd, count(*) AS common FROM bw JOIN dw USING (w) GROUP BY ALL)
"""


def shared_term_pairs(spark, sf_dir):
    """Pairs (item, document) that share a content term, with set sizes; an inverted join, so nothing that shares nothing is built."""
    side = lambda n, k, size: table(spark, sf_dir, n).select(k, T.content_set(F.col("text")).alias("ws")).select(k, F.size("ws").alias(size), F.explode("ws").alias("w"))
    b, d = side("benchmark", "item_id", "nb"), side("documents", "doc_id", "nd")
    return d.join(b, "w").groupBy("item_id", "doc_id", "nb", "nd").agg(F.count(F.lit(1)).alias("common"))


def contained(spark, sf_dir, share: float = 0.85):
    """Pairs (item_id, doc_id, nb, common) in which the document holds that share of the item's nb content terms. A document that lacks at most
    m of them holds one of the m + 1 that fewest documents hold, so only these meet documents; the sets are compared after that."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.content_set(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_set(F.col("text")).alias("own"))
    words, held = items.select("item_id", F.size("ws").alias("nb"), F.explode("ws").alias("w")), docs.select("doc_id", F.explode("own").alias("w"))
    df = held.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("df", "w"))
    rare = words.join(df, "w", "left").na.fill(0, ["df"]).withColumn("place", place).where(F.col("place") <= F.col("nb") - F.ceil(share * F.col("nb") - 1e-9) + 1)
    pairs = held.join(rare.select("item_id", "w"), "w").select("item_id", "doc_id").distinct()
    common = F.size(F.array_intersect("ws", "own"))
    met = pairs.join(items, "item_id").join(docs, "doc_id").select("item_id", "doc_id", F.size("ws").alias("nb"), common.alias("common"))
    return met.where(F.col("common") >= share * F.col("nb"))


@query("jaccard_bench_docs", _PAIRS + "SELECT item_id, doc_id, round(common / (nb + nd - common), 6) AS jaccard FROM p QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(common / (nb + nd - common), 6) DESC, doc_id) <= 3")
def jaccard_bench_docs(spark, sf_dir):
    """The three documents most like each item."""
    p = shared_term_pairs(spark, sf_dir).select("item_id", "doc_id", F.round(F.col("common") / (F.col("nb") + F.col("nd") - F.col("common")), 6).alias("jaccard"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("jaccard"), "doc_id"))
    return p.withColumn("r", rank).where("r <= 3").drop("r")


@query("containment_pairs", _PAIRS + "SELECT item_id, doc_id, round(common / nb, 6) AS containment FROM p WHERE common >= 0.85 * nb")
def containment_pairs(spark, sf_dir):
    """Items that a document contains almost whole."""
    return contained(spark, sf_dir).select("item_id", "doc_id", F.round(F.col("common") / F.col("nb"), 6).alias("containment"))


@query("truncate_docs", rf"""
WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents WHERE {n_tokens('text')} > 120),
c AS (SELECT *, {n_tokens('line')} AS n, sum({n_tokens('line')}) OVER (PARTITION BY doc_id ORDER BY i) AS total FROM l),
x AS (SELECT doc_id, coalesce(min(i) FILTER (total > 120), 1000000000) AS k FROM c GROUP BY doc_id),
p AS (SELECT c.doc_id, i, CASE WHEN i < k THEN line ELSE array_to_string(list_slice(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''), 1, floor((120 - (total - n)) / 1.33)::INT), ' ') || ' …' END AS piece
 FROM c JOIN x USING (doc_id) WHERE i < k OR (i = k AND floor((120 - (total - n)) / 1.33)::INT > 3))
SELECT doc_id, md5(coalesce(string_agg(piece, chr(10) ORDER BY i), '')) AS cut_md5 FROM x LEFT JOIN p USING (doc_id) GROUP BY doc_id
UNION ALL SELECT doc_id, md5(text) FROM documents WHERE {n_tokens('text')} <= 120""")
def truncate_docs(spark, sf_dir):
    """T8 at 120 tokens."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.truncate_to_tokens(F.col("text"), 120)).alias("cut_md5"))


@query("compact_sentences")
def compact_sentences(spark, sf_dir):
    """Documents compacted to 90 tokens around the first benchmark passage's terms."""
    terms = table(spark, sf_dir, "benchmark").groupBy().agg(F.min_by("text", "item_id").alias("q")).select(T.content_set(F.col("q")).alias("terms"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(terms))  # one row
    return d.select("doc_id", T.compact_text(F.col("text"), F.col("terms"), 90).alias("compacted"))


@query("embed_text_render", "SELECT doc_id, md5(source || ' | ' || lang || chr(10) || text) AS embed_md5, source || ' § ' || lang AS citation FROM documents")
def embed_text_render(spark, sf_dir):
    """T11 with the source as title and the language as section."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.embed_text(F.col("source"), F.col("lang"), F.col("text"))).alias("embed_md5"), T.citation(F.col("source"), F.col("lang")).alias("citation"))


_SYN = "(VALUES " + ", ".join(f"('{k}', {v!r})" for k, v in SYNONYMS.items()) + ") AS s(term, syns)"
_QUESTIONS = ("How do we revert a release after an outage?", "What is the database password rotation limit?", "Where are backups kept and how long is the max restore?")


@query("expand_query_terms", f"""
WITH q AS (SELECT unnest([{', '.join("'" + x + "'" for x in _QUESTIONS)}]) AS question), t AS (SELECT question, unnest(list_distinct({content('question')})) AS term FROM q),
e AS (SELECT question, unnest(list_distinct([term, term[:5]] || coalesce(syns, []) || list_transform(coalesce(syns, []), lambda x: x[:5]))) AS word, term FROM t LEFT JOIN {_SYN} USING (term))
SELECT question, term, string_agg(word, ',' ORDER BY word) AS expanded FROM e GROUP BY ALL""")
def expand_query_terms(spark, sf_dir):
    """T12 on literal questions."""
    q = spark.createDataFrame([(x,) for x in _QUESTIONS], "question string").select("question", F.explode(T.content_set(F.col("question"))).alias("term"))
    return q.select("question", "term", F.array_join(F.array_sort(T.expand_term(F.col("term"))), ",").alias("expanded"))


@query("term_overlap", f"""
WITH q AS (SELECT list_distinct(flatten(list_transform({content("'" + _QUESTIONS[0] + "'")}, lambda t: [t, t[:5]])) || ['deploy', 'rollout', 'rollback', 'incident', 'downtime']) AS qx),
d AS (SELECT doc_id, list_distinct(flatten(list_transform({content('text')}, lambda t: [t, t[:5]]))) AS ws FROM documents)
SELECT doc_id, len(list_intersect(ws, qx))::INT AS hits FROM d, q""")
def term_overlap(spark, sf_dir):
    """How many expanded terms of a question each document has."""
    qx = T.expand_terms(T.content_set(F.lit(_QUESTIONS[0])))
    return table(spark, sf_dir, "documents").select("doc_id", T.overlap(qx, F.col("text")).alias("hits"))


@query("prompt_section_extract", "SELECT conv_id, turn, regexp_extract('## Turn events' || chr(10) || role || chr(10) || '## Recent turns' || chr(10) || text || chr(10) || '## Current user message' || chr(10) || 'x', '(?s)## Recent turns\n(.*?)(?:\n## |\\z)', 1) AS section FROM conversations".replace("\\\\z", "\\z"))
def prompt_section_extract(spark, sf_dir):
    """T14 on prompts made from conversation turns."""
    nl = F.lit("\n")
    prompt = F.concat(F.lit("## Turn events\n"), F.col("role"), F.lit("\n## Recent turns\n"), F.col("text"), F.lit("\n## Current user message\nx"))
    del nl
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.prompt_section(prompt, "Recent turns").alias("section"))


@query("answer_keywords", "SELECT doc_id, contains(lower(text), 'license') AND contains(lower(text), 'under the') AS grounded FROM documents")
def answer_keywords(spark, sf_dir):
    """Documents that hold every keyword."""
    keys = T.words_array(["License", "under the"])
    return table(spark, sf_dir, "documents").select("doc_id", T.has_keywords(F.col("text"), keys).alias("grounded"))


@query("word_counts", f"SELECT doc_id, {n_words('text')}::INT AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))
