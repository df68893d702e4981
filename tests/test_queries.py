"""Registered queries against their SQL twins on the smallest tables, and streams against batch."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import text
from tessera.operators import remember
from tessera.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Cheap ones of every area; the driver compares all of them.
CHOSEN = ["tokenize_docs", "truncate_docs", "containment_pairs", "bm25_topk", "hybrid_topk", "slot_supersession", "extract_memories", "plan_retrieval", "compaction_stats", "page_sections", "sections_split", "render_tasks", "slot_history", "memory_recall", "consistency_pairs", "continuity_checks", "index_upkeep", "dense_topk_per_label", "prior_blend", "stream_sessionise", "stream_last_write"]


def cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v != v:
        return "NULL"
    return repr(round(float(v), 6)) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).values)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) > 70


def test_stream_working_memory_equals_batch(spark):
    stream = {(r.session, r["items"], r.tokens, r.evictions) for r in QUERIES["stream_working_memory"](spark, SF).collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    items = turns.select("conv_id", "turn", F.when(F.col("role") == "user", 2).otherwise(1).alias("priority"), text.count_tokens(F.col("text")).alias("tokens"))
    batch = {(r.conv_id, r["items"], r.tokens, r.evictions) for r in remember.working_memory(items, "conv_id", "turn", 12, 900).collect()}
    assert {x[:3] for x in stream} == {x[:3] for x in batch} and len(stream) == len(batch)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def odd_tables(spark, folder, talk=None):
    """The smallest tables, conversations among them as a folder of files, with these turns added (text by conv_id from 900000)."""
    for f in glob.glob(f"{SF}/*.parquet"):
        if "conversations" not in f:
            os.symlink(f, f"{folder}/{os.path.basename(f)}")
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    if talk:
        more = spark.createDataFrame([(900000 + i, 0, "user", t) for i, t in enumerate(talk)], rows.schema)
        rows = rows.unionByName(more)
    rows.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    rows = lambda d: sorted(tuple(map(cell, r)) for r in d[sorted(d.columns)].astype(object).values)
    assert rows(got) == rows(want)



#: Words that begin like a rule's word and go on in letters beyond ASCII, line ends, white space and folded letters that Java reads otherwise.
ODD_TALK = ["Doñez ñta.", "Isóla da.", "recallé esto", "Thanks\n", "thanks!\n\n", "Is it on?\v", "What\vnow", "we deciſion", "İs", "thankſ", "What is it? ", "we use Go\u0085 and more", "We use Kafka.\r\nYes", "My name is Zoë", "I prefer goñ", "I prefer Go"]


@pytest.mark.parametrize("name", ["plan_retrieval", "intent_counts", "efficiency_stats", "extract_memories"])
def test_rules_read_odd_texts_as_sql_does(spark, tmp_path, name):
    same_as_sql(spark, name, odd_tables(spark, tmp_path, ODD_TALK))


@pytest.mark.parametrize("name", ["stream_working_memory", "stream_last_write"])
def test_streams_read_folders_and_files_as_sql_does(spark, tmp_path, name):
    same_as_sql(spark, name, odd_tables(spark, tmp_path))


def test_md5_rows_are_made_without_a_shuffle_of_features(spark, tmp_path):
    """Features of all documents aren't exploded and grouped; buckets whose sum is zero have rows."""
    plan = QUERIES["md5_embed_docs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    same_as_sql(spark, "md5_embed_docs", SF)


def test_ablation_reads_documents_once_for_all_modes(spark, monkeypatch):
    from tessera.operators import dense, sparse

    calls = []
    for module, name in ((sparse, "index"), (sparse, "search"), (dense, "top_k")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **kw: calls.append(n) or f(*a, **kw))
    same_as_sql(spark, "ablation_by_mode", SF)
    assert sorted(calls) == ["index", "search", "top_k"]


def test_users_with_one_question_share_its_retrieval(spark, monkeypatch):
    from tessera.plans import assistant, retriever

    asked = []
    monkeypatch.setattr(retriever, "retrieve", lambda docs, q, *a, f=retriever.retrieve, **kw: asked.append(q.count()) or f(docs, q, *a, **kw))
    docs = spark.createDataFrame([(1, "the purchase of step 1 is late", "en", "web"), (2, "cats sleep", "en", "web")], "doc_id long, text string, lang string, source string")
    tasks = spark.createDataFrame([(u, "purchase", [("step 1", False, None)], "in_progress", 5) for u in range(9)], "user long, title string, steps array<struct<name:string,done:boolean,note:string>>, status string, updated int")
    got = assistant.pinned_knowledge(tasks, docs).collect()
    assert asked == [1] and {r.user for r in got} == set(range(9)) and {(r.key, r.place) for r in got} == {(1, 1)}
