"""Operators on small inputs whose results are known."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, dense, embedding, generate, optimize, remember, sessions, sparse
from tessera.sources import Collection, read_json, read_markdown


def test_bm25_counts_repeats_and_breaks_ties_by_key(spark):
    docs = spark.createDataFrame([(1, "pool pool limit"), (2, "pool"), (3, "pool"), (4, "cats")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "pool limits")], "qid long, text string")
    got = [(r.key, r.sparse_rank) for r in sparse.search(sparse.index(docs), q, "qid", "text", 10).orderBy("sparse_rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2)]


def test_dense_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "key long, embedding array<double>")
    got = dense.top_k(v, v.where("key < 5").withColumnRenamed("key", "qid"), 4).orderBy("qid", "dense_rank").collect()
    want = [k for q in range(5) for k in np.argsort(-(x @ x[q]), kind="stable")[:4]]
    assert [r.key for r in got] == want


def test_pool_embeds_as_config_says(spark):
    from tessera.config import DEFAULT
    from tessera.operators import fusion

    texts = {1: "deployment rollback", 2: "deploy the service", 3: "database conections", 4: "cats sleep"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    q = spark.createDataFrame([(0, "database connection deployments")], "qid long, text string")
    words = lambda t: [w for w in t.split() if w != "the"]
    one = lambda t: embedding.embed_words(words(t), DEFAULT.embed_dim).astype(float)
    got = {r.key: r.dense for r in fusion.pool(docs, q, "qid", "text").collect()}
    assert got.keys() == texts.keys() and all(abs(got[k] - one(t) @ one("database connection deployments")) < 2e-6 for k, t in texts.items())


def test_embedder_gives_unit_vectors_and_zero_for_nothing(spark):
    d = spark.createDataFrame([(1, "deploy the service"), (2, "the of"), (3, None)], "doc_id long, text string")
    got = {r.key: np.array(r.embedding) for r in embedding.hash_embed(d, dim=64).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6 and not got[2].any() and not got[3].any()


def test_sections_keep_skipped_levels_positional(spark):
    md = "intro é\n# A\n### B\nx\n### C  \n\ny\n\nz\n## D\n\n#no heading\n"
    d = spark.createDataFrame([("a.md", md), ("b.md", None), ("c.md", "only text")], "source string, markdown string")
    got = [(r.source, r.path, r.section, r.char_start, r.body) for r in chunking.split_sections(d).orderBy("source", "sec_no").collect()]
    at = lambda s: md.index(s) + len(s)
    assert got == [
        ("a.md", [], "Introduction", 0, "intro é"), ("a.md", ["A", "B"], "B", at("### B\n"), "x"), ("a.md", ["A", "B", "C"], "B > C", at("### C  \n"), "y\n\nz"),
        ("a.md", ["A", "D"], "D", at("## D\n"), "#no heading"), ("c.md", [], "Introduction", 0, "only text"),
    ]


def plain_vector(words, dim, grams, kind):
    """A text's vector, a feature at a time."""
    digest, low, sign = embedding.HASHES[kind]
    weight = {}
    for w in words:
        for f, x in embedding.word_features(w, grams):
            weight[f] = weight.get(f, 0.0) + x
    for a, b in zip(words, words[1:], strict=False):
        weight[f"b:{a}_{b}"] = weight.get(f"b:{a}_{b}", 0.0) + 0.8
    out = np.zeros(dim)
    for f, x in weight.items():
        h, x = digest(f), round(x, 6)
        out[(h >> low & 0xFFFFFFFF) % dim] += (1 if h >> sign & 1 else -1) * (1 + np.log(x) if x >= 1 else x)
    return out / (np.linalg.norm(out) or 1)


@pytest.mark.parametrize("kind", ["blake2b", "md5"])
def test_embedding_in_batches_equals_a_feature_at_a_time(monkeypatch, kind):
    monkeypatch.setattr(embedding, "PIECE_WORDS", 40)
    rng = np.random.default_rng(0)
    vocab = ["deploy", "outage", "backup", "db", "x", "services", "naïve", "config_v2", "rollback"]
    texts = [rng.choice(vocab, int(n)).tolist() for n in rng.integers(0, 30, 40)] + [None, [], ["x"] * 100]
    got = embedding.embed_lists(pa.array(texts, pa.list_(pa.string())), 64, (3, 4, 5), kind)
    assert np.abs(got - [plain_vector(t or [], 64, (3, 4, 5), kind) for t in texts]).max() < 1e-9


def test_buckets_of_known_features():
    """Golden values: bytes 0 to 3 of blake2b with 8 bytes, little-endian, give the bucket, the low bit of byte 4 the sign."""
    h = embedding.HASHES["blake2b"][0]("w:deploy")
    raw = hashlib.blake2b(b"w:deploy", digest_size=8).digest()
    assert h & 0xFFFFFFFF == int.from_bytes(raw[:4], "little") and h >> 32 & 1 == raw[4] & 1
    v = embedding.embed_words(["x"], 1024)
    assert {int(k) for k in np.flatnonzero(v)} == {int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest()[:4], "little") % 1024 for f in ("w:x", "s:x", "c3:<x>")}


def test_dense_search_in_cells_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((90, 6))
    v = spark.createDataFrame([(i, r.tolist(), int(i % 4)) for i, r in enumerate(x)], "key long, embedding array<double>, label int")
    q = v.where("key < 25").select(F.col("key").alias("qid"), "embedding")
    one = lambda **kw: sorted(map(tuple, dense.top_k(v, q, 3, **kw).collect()))
    whole, by = one(), one(by="label")
    pairs = sorted(map(tuple, dense.pairs_above(v, 0.5, "key", "embedding").collect()))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 10)
    monkeypatch.setattr(dense, "VECTOR_BLOCK", 40)
    assert one() == whole and one(by="label") == by and len(by) == 25 * 4 * 3
    assert sorted(map(tuple, dense.pairs_above(v, 0.5, "key", "embedding").collect())) == pairs and pairs


def test_index_is_kept_up(spark):
    """Adding, replacing and removing documents gives the index of what is left."""
    d = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    old = sparse.index(d([(1, "deploy the service deploys"), (2, "database backups"), (3, None), (4, "")]))
    now = sparse.with_added(sparse.without(old, spark.createDataFrame([(2,)], "key long")), d([(1, "rollback"), (9, "backup backup plan")]))
    want = sparse.index(d([(1, "rollback"), (3, None), (4, ""), (9, "backup backup plan")]))
    assert sorted(map(tuple, now.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert (9, 3, "backup", 2) in map(tuple, want.collect()) and sparse.stats(want).first().n == 4


def test_chunks_overlap_and_end_in_their_section(spark):
    body = " ".join(f"Sentence number {i} is here now." for i in range(60))
    d = spark.createDataFrame([("a.md", f"# T\n## A\n{body}\n## B\nShort one.\n")], "source string, markdown string")
    rows = chunking.chunk(d, target=60, overlap=15).orderBy("position").collect()
    assert {r.section for r in rows} == {"A", "B"} and len([r for r in rows if r.section == "A"]) > 3
    assert rows[0].text.split(". ")[-1] in rows[1].text and rows[0].title == "T"
    assert all(len(r.text.split()) * 1.33 <= 61 for r in rows)


def test_optimiser_filters_dedups_and_compacts(spark):
    long = "Pools hold forty connections for each service here. " + " ".join(f"Filler number {i} says nothing at all." for i in range(20))
    rows = [("q", "a", long, "pool connections", 0.9, 1.0), ("q", "b", long, "pool connections", 0.85, 1.0), ("q", "c", "weak", "pool connections", 0.1, 1.0), ("q", "d", "none", "pool connections", 0.8, 0.0)]
    items = spark.createDataFrame(rows, "qid string, key string, text string, question string, rerank double, coverage double")
    r = optimize.optimise(items, budget=40).first()
    assert (r.filtered, r.near_dups + r.exact_dups, r.compacted, r.output_items) == (2, 1, 1, 1) and r.output_tokens <= 40


def test_working_memory_keeps_priority_and_budget():
    held = sessions.evict([(2, 0, 10), (1, 1, 10), (1, 2, 10), (1, 3, 10)], 3, 900)
    assert held == [(2, 0, 10), (1, 2, 10), (1, 3, 10)]
    assert sessions.evict([(1, 0, 500), (1, 1, 500)], 12, 90) == [(1, 1, 500)]


def test_memory_rules_and_slot_supersession(spark):
    rows = [("u", 1, "I prefer Python."), ("u", 2, "I prefer Go."), ("u", 3, "We decided to use Kafka"), ("u", 4, "We've decided to use Kafka.")]
    said = spark.createDataFrame(rows, "user string, turn int, message string").select("user", "turn", F.explode(sessions.extract_memories(F.col("message"))).alias("x")).select("user", "turn", "x.*")
    kept = {r.text: r for r in remember.remember(said, "user", ["turn"], "text").collect()}
    assert set(kept) == {"User prefers Go", "Decision: use Kafka"}
    assert kept["User prefers Go"].history == "User prefers Python" and kept["Decision: use Kafka"].access_count == 1


def test_progress_is_for_statements_only(spark):
    said = spark.createDataFrame([("u", 1, "Done with the service manifest."), ("u", 2, "Have I finished the service manifest?")], "user string, msg_id int, message string")
    steps = spark.createDataFrame([("u", 0, "inventory"), ("u", 1, "service manifest")], "user string, step_no int, name string")
    assert [(r.msg_id, r.step_no) for r in sessions.track_progress(said, steps).collect()] == [(1, 1)]


def test_prompt_stays_within_budget(spark):
    d = spark.createDataFrame([("hello there", " ".join(["word"] * 400))], "m string, body string")
    built = sessions.build_prompt(["A", "B"], {"A": 100, "B": 500}, {"A": F.col("body"), "B": F.col("body")}, F.col("m"), 200, 10)
    r = d.select(built["total_tokens"].alias("n"), built["prompt"].alias("p")).first()
    assert r.n <= 205 and r.p.startswith("## A\n") and r.p.endswith("## Current user message\nhello there")


def test_answers_cite_their_source():
    got = generate.best_sentences("How long are backups kept?", ["Nothing here at all.", "Backups are kept for 14 days. Cats sleep."])
    assert got and got[0] == "Backups are kept for 14 days. [S2]"


def test_collection_round_trip(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    assert not c.exists() and c.count() == 0
    c.upsert(spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("b", "3", 2)], "key string, text string, n int"), ["n"])
    c.upsert(spark.createDataFrame([("c", "4", 1), ("a", "5", 1)], "key string, text string, n int"))
    c.update(spark.createDataFrame([("c", "6")], "key string, text string"), "text")
    c.delete(spark.createDataFrame([("b",)], "key string"))
    assert {(r.key, r.text) for r in c.all().collect()} == {("a", "5"), ("c", "6")} and c.get("a").first().text == "5"


def test_sources(spark, tmp_path):
    (tmp_path / "x.md").write_text("# T\ntext\n")
    (tmp_path / "q.json").write_text('[{"id": "q1", "question": "?"}]')
    assert read_markdown(spark, str(tmp_path)).first().asDict() == {"source": "x.md", "markdown": "# T\ntext\n"}
    assert read_json(spark, str(tmp_path / "q.json")).count() == 1


@pytest.mark.parametrize(("text", "intent"), [("thanks!", "smalltalk"), ("Where did we leave off?", "recall"), ("What is the pool limit?", "question"), ("The pool is full.", "statement")])
def test_plan(spark, text, intent):
    off = F.lit(False)
    assert spark.range(1).select(sessions.plan_retrieval(F.lit(text), off, off, F.lit(0.0), F.lit(0.0)).alias("p")).first().p.intent == intent


def test_working_memory_state_round_trip(spark):
    from tessera.operators import working as W

    s = W.set_var(W.advance(W.set_task(W.empty(), F.lit("Migrate"), F.array(F.lit("a"), F.lit("b")))), F.lit("region"), F.lit("eu"))
    row = spark.range(1).select(W.render(W.restore(W.snapshot(s))).alias("text"), W.render(W.complete_task(s)).alias("none")).first()
    assert row.text == "Active task: Migrate (status: in_progress)\n  [x] a\n  [>] b\n  vars: region=eu" and row.none == ""


def test_upfront_sections_are_cut_by_user(spark):
    from tessera.plans import assistant

    users = spark.createDataFrame([("u",), ("v",)], "user string")
    prefs = spark.createDataFrame([("u", "style", "concise")], "user string, key string, value string")
    tasks = spark.createDataFrame([("u", f"- t{i}", i) for i in range(3)], "user string, text string, updated int")
    prev = spark.createDataFrame([("u", 1, "old"), ("u", 2, None)], "user string, started int, summary string")
    mem = spark.createDataFrame([("u", f"m{i}", "fact", i / 10) for i in range(8)], "user string, text string, kind string, prior double")
    got = {r.user: r.asDict() for r in assistant.upfront(users, prefs, tasks, prev, mem).collect()}
    assert got["u"]["Task progress"] == "- t2\n- t1" and got["u"]["Previous sessions"] == "- 1: old"
    assert got["u"]["Long-term memories about this user"].startswith("- m7 (fact)\n- m6") and got["v"]["Task progress"] is None


def test_upfront_keeps_all_preferences(spark):
    from tessera.plans import assistant

    users = spark.createDataFrame([("u",)], "user string")
    prefs = spark.createDataFrame([("u", f"k{i:02}", "v") for i in range(60)], "user string, key string, value string")
    none = lambda s: spark.createDataFrame([], "user string, " + s)
    got = assistant.upfront(users, prefs, none("text string, updated int"), none("started int, summary string"), none("text string, kind string, prior double")).first()
    assert got["User profile & preferences"].split("\n") == [f"- k{i:02}: v" for i in range(60)]


def test_summary_with_an_earlier_one_in_front(spark):
    turns = spark.createDataFrame([("a", 1, "user", "one two three"), ("a", 2, "assistant", "no"), ("a", 3, "user", "four five"), ("b", 1, "user", "six"), ("c", 1, "assistant", "x")], "s string, n int, role string, text string")
    earlier = spark.createDataFrame([("a", "seven eight"), ("c", "nine"), ("b", None)], "s string, summary string")
    got = {r.s: r.summary for r in sessions.rolling_summary(turns, "s", "n", "role", "text", max_words=6, earlier=earlier).collect()}
    assert got == {"a": "seven eight; one two three", "b": "six", "c": "nine"}


def test_answers_acknowledge_recall_and_ground():
    task = {"title": "Migrate billing", "done": 1, "total": 3, "following": "health checks"}
    compose = generate.compose
    assert compose("thanks") == "Noted." and compose("What is the limit?") == generate.NOTHING
    assert compose("I prefer Go.", events=["Saved in long-term memory: User prefers Go."]) == "User prefers Go - noted for future sessions."
    assert compose("Done with it.", events=["Marked task step done: outline", "Next step: review"], pinned=["Review needs two people. More."]) == "Marked 'outline' as done. Next up: review. For that step: Review needs two people. [P1]"
    assert compose("Where did we leave off?", task=task) == "You're working on 'Migrate billing': 1 of 3 steps done, next step is 'health checks'."
    assert compose("What do you remember about me?", memories=["User prefers Go", "Region is eu"]) == "From memory: User prefers Go; Region is eu [M]"
    assert compose("What did we decide about Kafka?", memories=["Decision: use Kafka", "Region is eu"]).startswith("From memory: Decision: use Kafka [M]")
    sources = ["The pool limit is forty connections. Pools close at night.", "The connection pool limit was raised to fifty."]
    said = compose("What is the connection pool limit?", sources, concise=True)
    assert "[S1]" in said and said.count("[S") <= 2 and "night" not in said
    assert "[P1]" in compose("What is the connection pool limit?", pinned=sources[:1])


def test_whole_turns(spark):
    from tessera.plans import assistant

    docs = spark.createDataFrame([(1, "The connection pool limit is forty.", "en", "guide"), (2, "Backups run at night.", "en", "guide")], "doc_id long, text string, lang string, source string")
    steps = [("service manifest", True, None), ("health checks", False, None), ("pool limit", False, None)]
    tasks = spark.createDataFrame([("u", "Migrate billing", steps, "in_progress", 3, None)], "user string, title string, steps array<struct<name:string,done:boolean,note:string>>, status string, updated int, notes string")
    memories = spark.createDataFrame([("u", "User prefers Python", "preference", "pref:language", 0.5), ("v", "User prefers Rust", "preference", "pref:language", 0.9)], "user string, text string, kind string, slot string, prior double")
    said = ["I prefer Go.", "I finished the health checks.", "What do you remember about my Python preference?", "What is the connection pool limit?", "thanks!"]
    messages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(said)], "qid long, user string, text string")
    pinned = assistant.pinned_knowledge(tasks, docs)
    sections = messages.select("qid").withColumn("User profile & preferences", F.lit("- style: concise"))
    got = {r.qid: r for r in assistant.turns(messages, docs, sections, memories, tasks, pinned).collect()}
    assert got[0].events == "Updated in long-term memory: User prefers Go" and got[0].answer == "User prefers Go - noted for future sessions."
    assert got[1].events == "Marked task step done: health checks | Next step: pool limit" and got[1].intent == "update" and "Next up: pool limit." in got[1].answer
    assert got[2].n_memories == 1 and "User prefers Python" in got[2].answer and "Rust" not in got[2].answer
    assert "forty" in got[3].answer and got[4].answer == "Noted." and got[4].n_sources == 0


def test_dense_products_are_made_in_tiles_of_bounded_size(spark):
    """A cell or a batch never holds queries times vectors at once, and ties are still settled by key."""
    v = spark.range(5000).select(F.col("id").alias("key"), F.array(F.lit(1.0), (1 + F.col("id") % 7).cast("double")).alias("embedding"))

    def choose(scores, keys, ids):
        assert scores.size <= 1 << 21
        return dense._best(scores, keys, 3)

    found = dense._meet(v, v, "key", "embedding", "key", "embedding", None, choose, 3)
    assert {(r.qid, r.key) for r in found.where("qid in (8, 4999)").groupBy("qid", "key").count().collect()} >= {(q, k) for q in (8, 4999) for k in (6, 13, 20)}
    top = dense.top_k(v, v.where("key % 50 = 1").withColumnRenamed("key", "qid"), 3).groupBy("key").count().collect()
    assert {(r["key"], r["count"]) for r in top} == {(6, 100), (13, 100), (20, 100)}


def test_pool_meets_documents_once_and_finds_what_two_searches_find(spark, monkeypatch):
    from tessera.config import Config
    from tessera.operators import both, fusion

    rng = np.random.default_rng(5)
    vocab = [f"w{i}{'s' * (i % 3)}x{'s' * (i % 2)}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 60, 400)] + [None, "", "the of"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:20]])], "doc_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(vocab, 6)) if i else "the") for i in range(40)], "qid long, text string")
    config, cols = Config(dense_k=7, sparse_k=5), ["qid", "key", "dense", "dense_rank", "sparse", "sparse_rank", "fused"]
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    wanted = rows(fusion.pool(docs, q, "qid", "text", config=config, embed=embedding.Embedder("hashing", config.embed_dim).embed))
    asked = []
    monkeypatch.setattr(embedding, "hash_embed", lambda d, *a, f=embedding.hash_embed, **kw: asked.append(d.count()) or f(d, *a, **kw))
    monkeypatch.setattr(both, "NUMBERS", 16 * config.embed_dim)
    monkeypatch.setattr(both, "LEAST", 2)
    got = rows(fusion.pool(docs, q, "qid", "text", config=config))
    # documents are embedded inside the search, never as a table of vectors
    assert asked == [40] and len(got) == len(wanted)
    assert all(g[:2] == w[:2] and g[3] == w[3] and g[5] == w[5] and np.allclose([g[2], g[4], g[6]], [w[2], w[4], w[6]], atol=2e-6) for g, w in zip(got, wanted, strict=True))


def test_optimiser_takes_texts_apart_from_items(spark):
    texts = {1: "alpha beta gamma delta", 2: "alpha beta gamma delta epsilon", 3: "zeta eta theta. Iota kappa", 4: "nothing alike here"}
    items = spark.createDataFrame([(0, k, t, "alpha", 0.9 - k / 10, 0.5) for k, t in texts.items()], "qid long, key long, text string, question string, rerank double, coverage double")
    apart = optimize.optimise(items.drop("text"), rows=True, texts=spark.createDataFrame(list(texts.items()), "key long, text string"))
    cols = ["qid", "key", "final_rank", "rerank", "text", "tokens"]
    got, wanted = (sorted(map(tuple, d.select(*cols).collect())) for d in (apart, optimize.optimise(items, rows=True)))
    assert got == wanted and len(got) > 1
