"""Queries over collections, sessions, memories, tasks, planning, chunking and prompts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from ..config import SECTION_CAPS
from ..functions import text as T
from ..functions.words import RECALL_WORDS, STOPWORDS
from ..operators import chunking, generate, remember as R, sessions as M
from . import retriever
from .registry import eviction, n_tokens, n_words, norm, query, quoted, table, toks, truncated
from .text_queries import content

TURN = ["ts", "event_id"]
_W = "row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)"
_IMP = "least(1.0::DOUBLE, value / 500)"
_AGE = "(epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', ts))) / 86400"
_PRIOR = f"round({_IMP} * (0.5 + 0.5 * pow(0.5, {_AGE} / 30.0)), 6)"


def _events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumns({"ts": F.col("ts").cast("timestamp"), "importance": F.least(F.lit(1.0), F.col("value") / 500)})


def _prior(e: DataFrame) -> DataFrame:
    as_of = F.unix_timestamp(F.lit(dt.datetime(2024, 1, 31)).cast("timestamp_ntz").cast("timestamp"))
    age = (as_of - F.unix_timestamp("ts")) / 86400
    return e.withColumn("prior", F.round(M.prior(F.col("importance"), age), 6))


def _talk(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# ------------------------------------------------------------- collections


@query("collection_scan", "SELECT vec_id, label, len(embedding)::INT AS dim FROM embeddings")
def collection_scan(spark, sf_dir):
    """S6."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))


@query("point_lookup", "SELECT vec_id, label, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS norm FROM embeddings WHERE vec_id = 7")
def point_lookup(spark, sf_dir):
    """One key; the filter is pushed to the scan."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 7").select("vec_id", "label", F.round(T.cosine(F.col("embedding"), F.col("embedding")), 4).alias("norm"))


@query("collection_count", "SELECT 'documents' AS collection, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def collection_count(spark, sf_dir):
    """S12."""
    count = lambda n: table(spark, sf_dir, n).agg(F.lit(n).alias("collection"), F.count(F.lit(1)).alias("n"))
    return count("documents").unionByName(count("embeddings"))


@query("upsert_latest", f"SELECT user_id, event_type, event_id, value FROM events QUALIFY {_W} = 1")
def upsert_latest(spark, sf_dir):
    """The last write of each key."""
    return M.last_write(_events(spark, sf_dir), ["user_id", "event_type"], TURN).select("user_id", "event_type", "event_id", "value")


@query("update_payload", f"SELECT e.event_id, l.value AS value FROM events e JOIN (SELECT user_id, event_type, value FROM events QUALIFY {_W} = 1) l USING (user_id, event_type)")
def update_payload(spark, sf_dir):
    """Every key's payload is replaced by its newest one."""
    e = _events(spark, sf_dir)
    new = M.last_write(e, ["user_id", "event_type"], TURN).select("user_id", "event_type", F.col("value").alias("new"))
    return e.join(new, ["user_id", "event_type"]).select("event_id", F.col("new").alias("value"))


@query("delete_antijoin", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)")
def delete_antijoin(spark, sf_dir):
    """S11."""
    e = _events(spark, sf_dir)
    return e.join(e.where("event_type = 'error' AND value > 200").select("user_id").distinct(), "user_id", "left_anti").select("event_id", "user_id")


@query("touch_counts", f"SELECT user_id, event_type, count(*) - 1 AS access_count, round(least(1.0, max({_IMP}) + 0.05 * (count(*) > 1)::INT), 6) AS importance, max(event_id) AS last_id FROM events GROUP BY ALL")
def touch_counts(spark, sf_dir):
    """M4, M6: repeated memories."""
    n, top = F.count(F.lit(1)), F.max("importance")
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg((n - 1).alias("access_count"), F.round(F.when(n > 1, M.touch(top, top)).otherwise(F.least(F.lit(1.0), top)), 6).alias("importance"), F.max("event_id").alias("last_id"))


# ---------------------------------------------------------------- sessions


@query("recent_turns", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def recent_turns(spark, sf_dir):
    """W2."""
    return M.recent_turns(_talk(spark, sf_dir), "conv_id", "turn").select("conv_id", "turn", "role")


_SPLIT = "s AS (SELECT *, count(*) OVER (PARTITION BY conv_id) > 4 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2 AS folded FROM conversations)"


@query("compaction_split", f"WITH {_SPLIT} SELECT conv_id, turn, folded FROM s")
def compaction_split(spark, sf_dir):
    """W3 with limits that these short conversations reach."""
    return M.compaction_split(_talk(spark, sf_dir), "conv_id", "turn", keep=2, after=4).select("conv_id", "turn", "folded")


@query("live_messages", f"WITH {_SPLIT} SELECT conv_id, turn FROM s WHERE NOT folded")
def live_messages(spark, sf_dir):
    """F4."""
    return M.compaction_split(_talk(spark, sf_dir), "conv_id", "turn", keep=2, after=4).where("NOT folded").select("conv_id", "turn")


@query("compaction_stats", f"WITH {_SPLIT} SELECT conv_id, count(*) AS folded_turns, sum({n_tokens('text')})::BIGINT AS tokens_before FROM s WHERE folded GROUP BY conv_id")
def compaction_stats(spark, sf_dir):
    """M10."""
    folded = M.compaction_split(_talk(spark, sf_dir), "conv_id", "turn", keep=2, after=4).where("folded")
    return folded.groupBy("conv_id").agg(F.count(F.lit(1)).alias("folded_turns"), F.sum(T.count_tokens(F.col("text")).cast("long")).alias("tokens_before"))


_SAID = r"list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 1, 16)"


@query("rolling_summary", f"WITH u AS (SELECT conv_id, turn, {_SAID} AS ws, sum(len({_SAID})) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE role = 'user') SELECT conv_id, string_agg(array_to_string(ws, ' '), '; ' ORDER BY turn) AS summary FROM u WHERE used <= 90 GROUP BY conv_id")
def rolling_summary(spark, sf_dir):
    """T16, M10."""
    return M.rolling_summary(_talk(spark, sf_dir), "conv_id", "turn", "role", "text")


@query("session_rollup", f"SELECT conv_id, count(*) AS turns, sum({n_tokens('text')})::BIGINT AS tokens, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def session_rollup(spark, sf_dir):
    """M8, M9."""
    return _talk(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(T.count_tokens(F.col("text")).cast("long")).alias("tokens"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("previous_sessions", "WITH s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY ALL) SELECT user_id, day, n FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, last_id DESC) BETWEEN 2 AND 4")
def previous_sessions(spark, sf_dir):
    """The three sessions (days) of a user before the newest."""
    s = _events(spark, sf_dir).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"), F.desc("last_id")))
    return s.withColumn("r", rank).where("r BETWEEN 2 AND 4").select("user_id", "day", "n")


# ---------------------------------------------------------------- memories


_SLOT = "w AS (SELECT *, (floor(value / 100))::INT::VARCHAR AS v, lag((floor(value / 100))::INT::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events)"
_SLOTS = f"{_SLOT}, sl AS (SELECT user_id, event_type AS slot, arg_max(v, (ts, event_id)) AS value, count(*) FILTER (p IS NULL OR p <> v) - 1 AS superseded, count(*) FILTER (p = v) AS touched, round(max({_IMP}), 6) AS importance FROM w GROUP BY ALL)"


def _slots(spark, sf_dir):
    e = _events(spark, sf_dir).withColumns({"slot": F.col("event_type"), "v": F.floor(F.col("value") / 100).cast("int").cast("string")})
    return M.supersede(e, "user_id", "slot", "v", TURN, "importance")


@query("slot_supersession", f"WITH {_SLOTS} SELECT * FROM sl")
def slot_supersession(spark, sf_dir):
    """W8, M3."""
    return _slots(spark, sf_dir)


@query("memory_quality", f"WITH {_SLOTS} SELECT count(*) AS stored, count(*) FILTER (superseded > 0) AS with_history, sum(touched)::BIGINT AS touched, round(avg((importance >= 0.5)::INT), 3) AS useful FROM sl")
def memory_quality(spark, sf_dir):
    """E-6, A9."""
    s = _slots(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("stored"), F.count_if(F.col("superseded") > 0).alias("with_history"), F.sum("touched").alias("touched"), F.round(F.avg((F.col("importance") >= 0.5).cast("int")), 3).alias("useful"))


@query("recency_prior", f"SELECT event_id, {_PRIOR} AS prior FROM events")
def recency_prior(spark, sf_dir):
    """M5 as of 2024-01-31."""
    return _prior(_events(spark, sf_dir)).select("event_id", "prior")


@query("top_memories_prior", f"SELECT user_id, event_id, {_PRIOR} AS prior FROM events WHERE event_type IN ('purchase', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_PRIOR} DESC, event_id) <= 6")
def top_memories_prior(spark, sf_dir):
    """W5, M7, F2, F3."""
    own = _prior(_events(spark, sf_dir)).where(F.col("event_type").isin("purchase", "signup"))
    return M.top_by_prior(own, "user_id", 6, "event_id").select("user_id", "event_id", "prior")


@query("user_preferences", f"SELECT user_id, string_agg(event_type || '=' || (floor(value))::INT, ',' ORDER BY event_type) AS preferences FROM (SELECT * FROM events QUALIFY {_W} = 1) GROUP BY user_id")
def user_preferences(spark, sf_dir):
    """The last value of each preference of a user, as a map written out in order."""
    last = M.last_write(_events(spark, sf_dir), ["user_id", "event_type"], TURN)
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", "event_type", F.floor("value").cast("int").cast("string"))))
    return last.groupBy("user_id").agg(F.array_join(pairs, ",").alias("preferences"))


_PRIORITY = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END"


@query("working_memory_cap", f"SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_PRIORITY} DESC, ts DESC, event_id DESC) <= 12")
def working_memory_cap(spark, sf_dir):
    """W7 by the item cap."""
    e = _events(spark, sf_dir).withColumn("priority", F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1))
    return M.working_cap(e, "user_id", TURN).select("user_id", "event_id")


_ITEMS = "i AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS pos, CASE role WHEN 'user' THEN 2 ELSE 1 END AS priority, {t} AS tokens FROM {s})"


@query("working_memory_budget", f"WITH RECURSIVE {truncated('conversations', 'conv_id, turn', 'trim(text)', 220)}, {_ITEMS.format(t=n_tokens('short'), s='conversations JOIN cut USING (conv_id, turn)')}, {eviction('i')} SELECT session AS conv_id, len(s)::BIGINT AS items, list_sum(list_transform(s, lambda x: x.t))::BIGINT AS tokens, gone::BIGINT AS evictions, array_to_string(list_sort(list_transform(s, lambda x: x.at)), ',') AS turns FROM held")
def working_memory_budget(spark, sf_dir):
    """W7, M14 with both limits, folded in order by session."""
    turns = _talk(spark, sf_dir).select("conv_id", "turn", F.when(F.col("role") == "user", 2).otherwise(1).alias("priority"), T.truncate_to_tokens(F.trim("text"), 220).alias("content"))
    return R.working_memory(turns.withColumn("tokens", T.count_tokens(F.col("content"))), "conv_id", "turn", 12, 900)


#: Utterances that use every rule; conversations of the tables may hold none.
UTTERANCES = (
    "Hi, my name is Dana and I prefer concise answers.",
    "I prefer Python. I'd prefer to deploy on Fridays!",
    "We've decided to use Kafka for events, and the deadline is March 3.",
    "Let's go with Postgres.",
    "Remember that our region is eu-west-1.",
    "I'm migrating the billing service. Our stack runs Go, mostly.",
    "Please keep answers short.",
    "We use Terraform;",
    "thanks!",
    "Where did we leave off?",
    "What is the connection pool limit?",
    "I finished the service manifest.",
)


def _messages(spark, sf_dir) -> DataFrame:
    literal = spark.createDataFrame([(-1, i, u) for i, u in enumerate(UTTERANCES)], "conv_id long, turn long, text string")
    return literal.unionByName(_talk(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text"))


_SAYS = "m AS (SELECT -1 AS conv_id, i - 1 AS turn, u AS text FROM (SELECT unnest([{u}]) AS u, generate_subscripts([{u}], 1) AS i) UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role = 'user')".format(u=", ".join("'" + u.replace("'", "''") + "'" for u in UTTERANCES))


def _rule_sql(n: int) -> str:
    pattern, kind, importance, slot, words = M.MEMORY_RULES[n]
    guess = "CASE " + " ".join(f"WHEN regexp_matches(x, '(?i)\\b{w}\\b') THEN '{s}'" for w, s in M.PREFERENCE_SLOTS.items()) + " END"
    own = f"list_filter(list_transform(list_slice(vs, 1, i), lambda x: {guess}), lambda s: s IS NOT NULL)[1]" if kind == "preference" and slot is None else (f"'{slot}'" if slot else "NULL")
    said = "'" + words.replace("'", "''") + "' || vs[i]" if words else "upper(vs[i][1]) || vs[i][2:]"
    quote = pattern.replace("'", "''")
    vs = f"list_filter(list_transform(regexp_extract_all(text, '{quote}', 1), lambda v: regexp_replace(trim(v), '[,;]+$', '')), lambda v: length(v) >= 2)"
    return f"SELECT conv_id, turn, {said} AS memory, '{kind}' AS kind, {importance}::DOUBLE AS importance, {own} AS slot FROM (SELECT conv_id, turn, vs, unnest(range(1, len(vs) + 1)) AS i FROM (SELECT conv_id, turn, {vs} AS vs FROM m))"


@query("extract_memories", f"WITH {_SAYS} " + " UNION ALL ".join(_rule_sql(n) for n in range(len(M.MEMORY_RULES))))
def extract_memories(spark, sf_dir):
    """M1, M2."""
    found = _messages(spark, sf_dir).select("conv_id", "turn", F.explode(M.extract_memories(F.col("text"))).alias("x"))
    return found.select("conv_id", "turn", F.col("x.text").alias("memory"), "x.kind", "x.importance", "x.slot")


@query("remember_memories")
def remember_memories(spark, sf_dir):
    """M3: extracted memories written in order, with slots superseded and near copies merged."""
    found = extract_memories(spark, sf_dir).withColumn("user_id", F.col("conv_id"))
    return R.remember(found, "user_id", ["turn"], "memory")


# ---------------------------------------------------------------- planning

_Q = M.QUESTION.replace("'", "''")
_TOPICS = f"list_filter({toks('text')}, lambda w: w NOT IN {quoted(STOPWORDS)} AND w NOT IN {quoted(RECALL_WORDS)})"
_PLAN = f"""p AS (SELECT conv_id, turn, regexp_matches(text, '{M.SMALLTALK.replace("'", "''")}') AS small, regexp_matches(text, '{_Q}') AS question, regexp_matches(text, '{M.MEMORY_CUE}') AS wants, len({_TOPICS}) AS topics, regexp_matches(text, '(?i)i finished') AS done FROM m),
plan AS (SELECT conv_id, turn, NOT (small OR (NOT question AND done) OR (wants AND topics = 0)) AS knowledge, NOT small AND NOT (NOT question AND done) AND wants AS memories,
 CASE WHEN small THEN 'smalltalk' WHEN NOT question AND done THEN 'update' WHEN wants AND topics = 0 THEN 'recall' WHEN question THEN 'question' ELSE 'statement' END AS intent FROM p)"""


def _plan(spark, sf_dir) -> DataFrame:
    done = F.col("text").rlike(T.java_pattern("(?i)i finished"))
    plan = M.plan_retrieval(F.col("text"), F.lit(False), done, F.lit(0.0), F.lit(0.0))
    return _messages(spark, sf_dir).select("conv_id", "turn", plan.alias("p")).select("conv_id", "turn", "p.*")


@query("plan_retrieval", f"WITH {_SAYS}, {_PLAN} SELECT * FROM plan")
def plan_retrieval(spark, sf_dir):
    """M16, F7."""
    return _plan(spark, sf_dir)


@query("intent_counts", f"WITH {_SAYS}, {_PLAN} SELECT intent, count(*) AS n, count(*) FILTER (knowledge) AS jit FROM plan GROUP BY intent")
def intent_counts(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.count_if("knowledge").alias("jit"))


@query("efficiency_stats", f"WITH {_SAYS}, {_PLAN} SELECT count(*) AS turns, count(*) FILTER (knowledge) AS jit_calls, count(*) FILTER (NOT knowledge) AS none_needed, round(avg({n_tokens('text')}), 3) AS mean_tokens, max({n_tokens('text')}) AS max_tokens FROM plan JOIN m USING (conv_id, turn)")
def efficiency_stats(spark, sf_dir):
    """E-9, A10."""
    j = _plan(spark, sf_dir).join(_messages(spark, sf_dir), ["conv_id", "turn"])
    t = T.count_tokens(F.col("text"))
    return j.agg(F.count(F.lit(1)).alias("turns"), F.count_if("knowledge").alias("jit_calls"), F.count_if(~F.col("knowledge")).alias("none_needed"), F.round(F.avg(t), 3).alias("mean_tokens"), F.max(t).alias("max_tokens"))


# ------------------------------------------------------------------- tasks

def task_table(spark, sf_dir) -> DataFrame:
    """A task for each user and event type, a step for each event; a step whose value is small is done."""
    e = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("task_id"), F.max("ts").alias("updated"), F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    steps = F.transform("e", lambda s, i: F.struct(F.concat(F.lit("step "), (i + 1).cast("string")).alias("name"), (s["value"] < 60).alias("done"), F.lit(None).cast("string").alias("note")))
    t = e.select("task_id", F.col("user_id").alias("user"), F.col("event_type").alias("title"), steps.alias("steps"), "updated", F.lit(None).cast("string").alias("notes"))
    return t.withColumn("status", M.task_status(F.col("steps")))


_STEPS = "t AS (SELECT min(event_id) AS task_id, user_id AS usr, event_type AS title, list(value < 60 ORDER BY ts, event_id) AS done, max(ts) AS updated FROM events GROUP BY user_id, event_type)"
_STATUS = "CASE WHEN list_contains({d}, false) THEN 'in_progress' ELSE 'done' END"
_DONE = "len(list_filter({d}, lambda d: d))"


@query("open_tasks", f"WITH {_STEPS} SELECT usr AS user, title, row_number() OVER (PARTITION BY usr ORDER BY updated DESC, task_id)::INT AS place FROM t WHERE list_contains(done, false)")
def open_tasks(spark, sf_dir):
    """F5."""
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("updated"), "task_id"))
    return task_table(spark, sf_dir).where("status != 'done'").select("user", "title", rank.alias("place"))


@query("next_step", f"WITH {_STEPS} SELECT task_id, 'step ' || list_position(done, false) AS next_step, {_DONE.format(d='done')} || '/' || len(done) AS progress FROM t")
def next_step(spark, sf_dir):
    """W6, A11."""
    done = F.size(F.filter("steps", lambda s: s["done"])).cast("string")
    return task_table(spark, sf_dir).select("task_id", M.next_step(F.col("steps")).alias("next_step"), F.concat_ws("/", done, F.size("steps").cast("string")).alias("progress"))


@query("complete_step", f"WITH {_STEPS}, d AS (SELECT task_id, list_transform(range(1, len(done) + 1), lambda i: done[i] OR i <= 2) AS nd FROM t) SELECT task_id, {_DONE.format(d='nd')}::INT AS n_done, {_STATUS.format(d='nd')} AS status FROM d")
def complete_step(spark, sf_dir):
    """The first two steps of every task are done."""
    steps = M.complete_step(M.complete_step(F.col("steps"), F.lit("step 1"), F.lit("done")), F.lit("step 2"), F.lit("done"))
    t = task_table(spark, sf_dir).select("task_id", steps.alias("steps"))
    return t.select("task_id", F.size(F.filter("steps", lambda s: s["done"])).alias("n_done"), M.task_status(F.col("steps")).alias("status"))


@query("render_tasks", f"""WITH {_STEPS} SELECT task_id, '- ' || title || ' — ' || {_DONE.format(d='done')} || '/' || len(done) || ' steps done (status: ' || {_STATUS.format(d='done')} || ')' || chr(10)
 || array_to_string(list_transform(range(1, len(done) + 1), lambda i: '    [' || CASE WHEN done[i] THEN 'x' ELSE ' ' END || '] step ' || i), chr(10)) || coalesce(chr(10) || '    next: step ' || list_position(done, false), '') AS text FROM t""")
def render_tasks(spark, sf_dir):
    """T20."""
    return task_table(spark, sf_dir).select("task_id", T.render_task(F.col("title"), F.col("status"), F.col("steps"), F.col("notes")).alias("text"))


@query("memory_recall", f"""WITH m AS (SELECT user_id, event_type, floor(value / 100)::INT AS v, {_PRIOR} AS prior, event_id, {_W} AS r FROM events),
now AS (SELECT user_id, event_type, v FROM m WHERE r = 1),
top AS (SELECT user_id, event_type, v FROM m WHERE r <= 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY prior DESC, event_id) <= 3),
p AS (SELECT n.user_id, n.event_type, coalesce(bool_or(t.v = n.v), false) AS found, coalesce(bool_or(t.v <> n.v), false) AS stale FROM now n LEFT JOIN top t USING (user_id, event_type) GROUP BY ALL)
SELECT count(*) AS probes, round(avg(found::INT), 3) AS recall3, round(avg(stale::INT), 3) AS stale_rate FROM p""")
def memory_recall(spark, sf_dir):
    """E-6: each user is asked for the value of each slot; of the three memories that come up by prior, whether one holds the value
    that stands now (recall), or one that has been superseded (stale). Memories are the last three writes of a slot."""
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    m = _prior(_events(spark, sf_dir)).select("user_id", "event_type", F.floor(F.col("value") / 100).cast("int").alias("v"), "prior", "event_id", rank.alias("r")).where("r <= 3")
    now = m.where("r = 1").select("user_id", "event_type", F.col("v").alias("now"))
    top = M.top_by_prior(m, "user_id", 3, "event_id").select("user_id", "event_type", "v")
    p = now.join(top, ["user_id", "event_type"], "left").groupBy("user_id", "event_type").agg(F.coalesce(F.bool_or(F.col("v") == F.col("now")), F.lit(False)).alias("found"), F.coalesce(F.bool_or(F.col("v") != F.col("now")), F.lit(False)).alias("stale"))
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 3)
    return p.agg(F.count(F.lit(1)).alias("probes"), mean("found").alias("recall3"), mean("stale").alias("stale_rate"))


@query("slot_history", "WITH w AS (SELECT user_id, event_type AS slot, floor(value / 100)::INT::VARCHAR AS v, lag(floor(value / 100)::INT::VARCHAR) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS back, ts, event_id FROM events), k AS (SELECT *, lead(v) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) AS nxt FROM w) SELECT user_id, slot, coalesce(string_agg(v, ',' ORDER BY ts, event_id) FILTER (nxt IS NOT NULL AND nxt <> v), '') AS history FROM k GROUP BY ALL")
def slot_history(spark, sf_dir):
    """The values that each slot had before its present one, in the order in which they were superseded."""
    e = _events(spark, sf_dir).withColumns({"slot": F.col("event_type"), "v": F.floor(F.col("value") / 100).cast("int").cast("string")})
    return M.history(e, "user_id", "slot", "v", TURN)


@query("task_progress")
def task_progress(spark, sf_dir):
    """M15, T18, J10."""
    said = spark.createDataFrame([("u1", 1, "Done with the health check."), ("u2", 1, "Did we finish the review?"), ("u2", 2, "I've completed the review, finally.")], "user string, msg_id int, message string")
    open_ = spark.createDataFrame([("u1", [("service manifest", True), ("health checks", False), ("traffic cutover", False)]), ("u2", [("outline", True), ("review", False)])], "user string, steps array<struct<name:string,done:boolean>>")
    steps = open_.select("user", F.posexplode("steps").alias("step_no", "s")).where("NOT s.done").select("user", "step_no", "s.name")
    return M.track_progress(said, steps)


# ---------------------------------------------------------- prompts, answers

SYSTEM_TOKENS = 100


@query("prompt_sections_budget")
def prompt_sections_budget(spark, sf_dir):
    """A prompt for the last user turn of each conversation, within 600 tokens."""
    talk = _talk(spark, sf_dir)
    last = talk.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("message"), F.max("turn").alias("at"))
    recent = M.recent_turns(talk, "conv_id", "turn").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("recent"))
    summary = M.rolling_summary(talk, "conv_id", "turn", "role", "text")
    rows = last.join(recent, "conv_id", "left").join(summary, "conv_id", "left")
    columns = {n: F.lit("") for n in SECTION_CAPS} | {"Recent turns": F.col("recent"), "Conversation summary": F.col("summary")}
    built = M.build_prompt(list(SECTION_CAPS), SECTION_CAPS, columns, F.col("message"), 600, SYSTEM_TOKENS)
    return rows.select("conv_id", F.md5(built["prompt"]).alias("prompt_md5"), built["total_tokens"].alias("total_tokens"))


@query("answer_questions")
def answer_questions(spark, sf_dir):
    """Extractive answers to the benchmark's passages as questions, from their re-ranked documents."""
    docs, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = retriever.retrieve(docs, q).where("rank < 4").join(docs.select(F.col("doc_id").alias("key"), "text"), "key")
    sources = ranked.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("sources"))
    return generate.answers(sources.join(q.select(F.col("item_id").alias("qid"), F.col("text").alias("question")), "qid"))


_ANSWERS = f"""a AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who, role FROM conversations),
s AS (SELECT conv_id, turn, list_sort(list_distinct({content('question')})) AS q, list_distinct({content('answer')}) AS w, {norm('question')} AS said FROM a WHERE role = 'user' AND who = 'assistant'),
k AS (SELECT *, md5(array_to_string(q, ' ')) AS h, list_slice(list_sort(q, 'DESC'), 1, 2) AS keys FROM s WHERE len(q) > 0),
f AS (SELECT *, first_value(w) OVER o AS w1, first_value(said) OVER o AS said1, row_number() OVER o AS n FROM k WINDOW o AS (PARTITION BY h ORDER BY conv_id, turn)),
x AS (SELECT CASE WHEN said = said1 THEN 'repeat' ELSE 'paraphrase' END AS variant, w, w1, len(list_intersect(keys, w)) = len(keys) AS ok, len(list_intersect(keys, w1)) = len(keys) AS ok1 FROM f WHERE n > 1)"""


@query("consistency_pairs", f"WITH {_ANSWERS} SELECT variant, count(*) AS pairs, round(avg((ok = ok1)::INT), 3) AS agreement, round(avg((ok AND ok1)::INT), 3) AS both_correct, round(avg(CASE WHEN len(w) = 0 OR len(w1) = 0 THEN 0 ELSE len(list_intersect(w, w1)) / len(list_distinct(w || w1)) END), 6) AS jaccard FROM x GROUP BY variant")
def consistency_pairs(spark, sf_dir):
    """E-7, J11, A12 by variant: answers to a question that was asked before, in the same words (repeat) or the same content words in
    other ones (paraphrase), against the first answer. An answer is correct if it holds the question's two keywords."""
    ahead = lambda c: F.lead(c).over(Window.partitionBy("conv_id").orderBy("turn"))
    a = _talk(spark, sf_dir).withColumns({"answer": ahead("text"), "by": ahead("role")}).where("role = 'user' AND by = 'assistant'")
    s = a.select("conv_id", "turn", F.array_sort(T.content_set(F.col("text"))).alias("q"), T.content_set(F.col("answer")).alias("w"), T.normalise(F.col("text")).alias("said")).where(F.size("q") > 0)
    s = s.withColumns({"h": F.md5(F.array_join("q", " ")), "keys": F.slice(F.reverse("q"), 1, 2)})
    # the first answer to a question is one row of a pre-aggregated group, joined back to the others
    first = s.groupBy("h").agg(F.min(F.struct("conv_id", "turn", "w", "said")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "f")
    x = s.join(first, "h").where("conv_id != f.conv_id OR turn != f.turn")
    holds = lambda w: F.size(F.array_intersect("keys", w)) == F.size("keys")
    x = x.select(F.when(F.col("said") == F.col("f.said"), "repeat").otherwise("paraphrase").alias("variant"), holds(F.col("w")).alias("ok"), holds(F.col("f.w")).alias("ok1"), T.jaccard(F.col("w"), F.col("f.w")).alias("j"))
    mean = lambda c, n: F.round(F.avg(c), n)
    return x.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), mean((F.col("ok") == F.col("ok1")).cast("int"), 3).alias("agreement"), mean((F.col("ok") & F.col("ok1")).cast("int"), 3).alias("both_correct"), mean("j", 6).alias("jaccard"))


@query("continuity_checks", f"""WITH f AS (SELECT conv_id, list_sort(list_transform(list_distinct({content('text')}), lambda w: printf('%04d', 9999 - length(w)) || w))[1][5:] AS needle FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
c AS (SELECT conv_id, needle, coalesce(bool_or(role = 'assistant' AND list_contains({toks('text')}, needle)), false) AS passed FROM f JOIN conversations USING (conv_id) WHERE needle IS NOT NULL GROUP BY ALL)
SELECT conv_id, needle, passed FROM c""")
def continuity_checks(spark, sf_dir):
    """E-8: whether what a user names first, the longest content word of the first message, comes up in a later answer."""
    talk = _talk(spark, sf_dir)
    first = talk.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    longest = F.get(F.array_sort(F.transform(T.content_set(F.col("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    first = first.select("conv_id", longest.alias("needle")).where("needle IS NOT NULL")
    held = (F.col("role") == "assistant") & F.array_contains(T.tokens(F.col("text")), F.col("needle"))
    return talk.join(first, "conv_id").groupBy("conv_id", "needle").agg(F.coalesce(F.bool_or(held), F.lit(False)).alias("passed"))


# ---------------------------------------------------------------- chunking

_HTML = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"
_TAGS = "regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')"


@query("page_sections", f"SELECT page_id, trim({_TAGS.format(x=_HTML)}) AS title, len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1))::INT AS paragraphs, {n_words('trim(' + _TAGS.format(x=_HTML) + ')')}::INT AS title_words FROM pages")
def page_sections(spark, sf_dir):
    """C1-C3 on pages: heading and paragraphs."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    title = plain(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("paragraphs"), T.word_count(title).alias("title_words"))


def pages_as_markdown(spark, sf_dir) -> DataFrame:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    body = F.array_join(F.transform(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), plain), "\n\n")
    head = plain(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".md")).alias("source"), F.concat(F.lit("# "), head, F.lit("\n\n## Text\n\n"), body).alias("markdown"))


@query("sections_split", f"SELECT 'page-' || page_id || '.md' AS source, 0 AS sec_no, t || ' / Text' AS path, 'Text' AS section, (length(t) + 12)::INT AS char_start FROM (SELECT page_id, trim({_TAGS.format(x=_HTML)}) AS t, list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda p: trim({_TAGS.format(x='p')})), lambda p: p <> '') AS ps FROM pages) WHERE len(ps) > 0")
def sections_split(spark, sf_dir):
    """C1 on pages rendered as Markdown."""
    return chunking.split_sections(pages_as_markdown(spark, sf_dir)).select("source", "sec_no", F.array_join("path", " / ").alias("path"), "section", "char_start")


@query("chunk_pack")
def chunk_pack(spark, sf_dir):
    """C1-C5, C11 on pages rendered as Markdown."""
    c = chunking.chunk(pages_as_markdown(spark, sf_dir))
    return c.select("chunk_id", "source", "section", "position", T.count_tokens(F.col("text")).alias("tokens"))
