"""Sessions, memories and tasks in batch form (W2-W8, M1-M16): ordered windows and built-in array functions by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULT
from ..functions import text as T
from ..functions.words import RECALL_WORDS, STOPWORDS

#: What a message says about itself.
SMALLTALK = r"(?i)^\s*(hi|hello|hey|thanks|thank you|ok|okay|cool|great|bye|good (morning|night))\b[\s!.]*$"
MEMORY_CUE = (
    r"(?i)\b(remember|recall|last (time|session|week)|previous(ly)?|earlier|decid(e|ed)|decision|where were we|"
    r"le(ft|ave) off|progress|my (name|preference|deadline|service|region)|what do you know about me|next step)\b"
)
STEP_DONE = r"(?i)\b(?:i(?:'ve| have)? )?(?:finished|completed|done with)\s+(?:the\s+)?(.+?)(?:[.!?,]|$)"
QUESTION = r"(?i)\?\s*$|^\s*(what|which|how|why|when|where|who|can|could|should|do|does|is|are)\b"

#: Fixed values: (pattern, kind, importance, slot, how the match is worded).
MEMORY_RULES = (
    (r"(?i)\bmy name is ([A-Z][\w\-]+)", "fact", 0.9, "profile:name", "User's name is "),
    (r"(?i)\bI(?:'d| would)? prefer (?:to )?(.+?)(?:[.!?]|$)", "preference", 0.8, None, "User prefers "),
    (r"(?i)\b(?:please )?(?:always|keep) (?:answers?|responses?|replies) (.+?)(?:[.!?]|$)", "preference", 0.8, "pref:style", "User prefers "),
    (r"(?i)\bwe(?:'ve| have)? decided (?:to )?(.+?)(?:[.!?]|$)", "decision", 0.85, None, "Decision: "),
    (r"(?i)\blet'?s go with (.+?)(?:[.!?]|$)", "decision", 0.8, None, "Decision: "),
    (r"(?i)\bremember that (.+?)(?:[.!?]|$)", "fact", 0.9, None, ""),
    (r"(?i)\b(?:the )?deadline is (.+?)(?:[.!?]|$)", "fact", 0.85, "project:deadline", "Project deadline is "),
    (r"(?i)\bI(?:'m| am) ((?:working on|migrating|building) .+?)(?:[.!?]|$)", "fact", 0.75, "project:current", "User is "),
    (r"(?i)\bour (?:service|app|team|stack) (?:is|uses|runs) (.+?)(?:[.!?]|$)", "fact", 0.7, None, ""),
    (r"(?i)\b(?:we use|we're using|we are using) (.+?)(?:[.!?]|$)", "fact", 0.7, None, ""),
    (r"(?i)\bour region is ([\w\-]+)", "fact", 0.8, "project:region", "User's deployment region is "),
)
#: Words of a preference and the slot they fill, first match first.
PREFERENCE_SLOTS = {
    "python": "pref:language",
    "go": "pref:language",
    "typescript": "pref:language",
    "java": "pref:language",
    "concise": "pref:style",
    "short": "pref:style",
    "detailed": "pref:style",
    "bullet": "pref:style",
}


def last_first(by: str | list[str], *order) -> Window:
    return Window.partitionBy(by).orderBy(*order)


def recent_turns(messages: DataFrame, session: str, order: str, n: int = DEFAULT.session_recent_turns) -> DataFrame:
    """W2."""
    rank = F.row_number().over(last_first(session, F.desc(order)))
    return messages.withColumn("back", rank).where(F.col("back") <= n)


def compaction_split(messages: DataFrame, session: str, order: str, keep: int = DEFAULT.session_recent_turns, after: int = DEFAULT.session_compact_after) -> DataFrame:
    """Folded marks the turns that a session of more than after live turns folds into its summary."""
    back = F.row_number().over(last_first(session, F.desc(order)))
    live = F.count(F.lit(1)).over(Window.partitionBy(session))
    return messages.withColumns({"live": live, "back": back}).withColumn("folded", (F.col("live") > after) & (F.col("back") > keep))


def rolling_summary(folded: DataFrame, session: str, order: str, role: str, text: str, max_words: int = 90, clip: int = 16, earlier: DataFrame | None = None) -> DataFrame:
    """A session's own user statements, clipped, oldest first, until the next would exceed max_words. earlier (session, summary): what
    had been folded before; it stands in front, and its words count."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    said = folded.where(F.col(role) == "user").select(session, order, F.slice(words, 1, clip).alias("ws"))
    run = F.sum(F.size("ws")).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    lines = lambda d: d.groupBy(session).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "ws"))), lambda x: F.array_join(x["ws"], " ")), "; ").alias("summary"))
    said = said.withColumn("used", run)
    if earlier is None:
        return lines(said.where(F.col("used") <= max_words))
    before = earlier.select(session, F.col("summary").alias("before")).where(F.coalesce("before", F.lit("")) != "")
    taken = F.coalesce(T.word_count(F.col("before")), F.lit(0))
    new = lines(said.join(before, session, "left").where(F.col("used") + taken <= max_words))
    return before.join(new, session, "full").select(session, F.concat_ws("; ", "before", "summary").alias("summary"))


def last_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("rank", rank).where("rank = 1").drop("rank")


def supersede(writes: DataFrame, user: str, slot: str, value: str, order: list[str], importance: str) -> DataFrame:
    """For each slot its last value, the distinct values before it, the highest importance and how often it was touched."""
    before = F.lag(value).over(Window.partitionBy(user, slot).orderBy(*order))
    marked = writes.withColumn("changed", F.coalesce(F.lower(F.trim(before)) != F.lower(F.trim(F.col(value))), F.lit(True)).cast("int"))
    agg = marked.groupBy(user, slot).agg(F.max_by(value, F.struct(*order)).alias("value"), (F.sum("changed") - 1).alias("superseded"), F.sum(1 - F.col("changed")).alias("touched"), F.round(F.max(importance), 6).alias("importance"))
    return agg


def history(writes: DataFrame, user: str, slot: str, value: str, order: list[str]) -> DataFrame:
    """For each slot the values that were superseded, oldest first, joined by commas."""
    after = F.lead(value).over(Window.partitionBy(user, slot).orderBy(*order))
    gone = writes.withColumn("gone", F.coalesce(F.lower(F.trim(after)) != F.lower(F.trim(F.col(value))), F.lit(False)))
    kept = F.sort_array(F.collect_list(F.when(F.col("gone"), F.struct(*order, F.col(value).alias("value")))))
    return gone.groupBy(user, slot).agg(F.array_join(F.transform(kept, lambda x: x["value"]), ",").alias("history"))


def prior(importance: Column, age_days: Column, half_life: float = DEFAULT.half_life_days) -> Column:
    """M5: importance times recency."""
    return importance * (0.5 + 0.5 * F.pow(F.lit(0.5), age_days / half_life))


def top_by_prior(memories: DataFrame, user: str, n: int, *tie) -> DataFrame:
    """W5, M7."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("prior"), *tie))
    return memories.withColumn("rank", rank).where(F.col("rank") <= n)


def touch(importance_old: Column, importance_new: Column) -> Column:
    """M4: a repeated memory gains a little."""
    return F.least(F.lit(1.0), F.greatest(importance_old, importance_new) + 0.05)


def extract_memories(message: Column) -> Column:
    """M1, M2: array of text, kind, importance, slot in the order of the rules; a preference's own slot, once inferred, holds for the rule's later matches in the message."""
    empty = F.array().cast("array<struct<text:string,kind:string,importance:double,slot:string>>")
    every = []
    for pattern, kind, importance, slot, words in MEMORY_RULES:
        value = lambda v: F.regexp_replace(F.trim(v), r"[,;]+$", "")
        found = F.filter(F.transform(F.regexp_extract_all(message, F.lit(T.java_pattern(pattern)), F.lit(1)), value), lambda v: F.length(v) >= 2)
        guess = lambda v: F.coalesce(*[F.when(v.rlike(T.java_pattern(rf"(?i)\b{w}\b")), F.lit(s)) for w, s in PREFERENCE_SLOTS.items()])
        say = (lambda v, words=words: F.concat(F.lit(words), v)) if words else (lambda v, words=words: F.concat(F.upper(F.left(v, F.lit(1))), F.substring(v, F.lit(2), F.length(v))))

        def made(vs, kind=kind, importance=importance, slot=slot, say=say, guess=guess):
            def one(v, i):
                own = F.lit(slot)
                if kind == "preference" and slot is None:
                    own = F.get(F.filter(F.transform(F.slice(vs, 1, i + 1), lambda x: guess(x)), lambda s: s.isNotNull()), F.lit(0))
                return F.struct(say(v).alias("text"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), own.alias("slot"))

            return F.transform(vs, one)

        every.append(F.coalesce(made(found), empty))
    return F.concat(*every)


def plan_retrieval(message: Column, wrote_memory: Column, steps_done: Column, pinned_score: Column, pinned_coverage: Column) -> Column:
    """Knowledge, memories, intent; rules in order."""
    question, wants = message.rlike(T.java_pattern(QUESTION)), message.rlike(T.java_pattern(MEMORY_CUE))
    topics = F.filter(T.tokens(message), lambda t: ~t.isin(*STOPWORDS) & ~t.isin(*RECALL_WORDS))
    row = lambda k, m, intent: F.struct(k.alias("knowledge"), m.alias("memories"), intent.alias("intent"))
    no, yes = F.lit(False), F.lit(True)
    return (
        F.when(message.rlike(T.java_pattern(SMALLTALK)), row(no, no, F.lit("smalltalk")))
        .when(~question & (wrote_memory | steps_done), row(no, no, F.lit("update")))
        .when(wants & (F.size(topics) == 0), row(no, yes, F.lit("recall")))
        .when(question & (pinned_score >= 0.55) & (pinned_coverage >= 0.6), row(no, wants, F.lit("question")))
        .otherwise(row(yes, wants, F.when(question, "question").otherwise("statement")))
    )


def complete_step(steps: Column, done_name: Column, note: Column) -> Column:
    """Steps with the named one done."""
    return F.transform(steps, lambda s: F.struct(s["name"].alias("name"), (s["done"] | (s["name"] == done_name)).alias("done"), F.when(s["name"] == done_name, note).otherwise(s["note"]).alias("note")))


def task_status(steps: Column) -> Column:
    """A11."""
    return F.when(F.forall(steps, lambda s: s["done"]), "done").otherwise("in_progress")


def next_step(steps: Column) -> Column:
    """W6."""
    return F.get(F.filter(steps, lambda s: ~s["done"]), F.lit(0))["name"]


@F.pandas_udf(DoubleType())
def sequence_ratio(a, b):
    """Matching-blocks ratio of two strings, in Arrow batches."""
    import pandas as pd
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def track_progress(messages: DataFrame, steps: DataFrame, least: float = 0.5) -> DataFrame:
    """Messages (user, msg_id, message) against open steps (user, step_no, name): the best open step of each completion phrase. Questions complete nothing."""
    said = messages.where(~F.col("message").rlike(T.java_pattern(QUESTION))).select("user", "msg_id", F.posexplode(F.regexp_extract_all("message", F.lit(T.java_pattern(STEP_DONE)), F.lit(1))).alias("n", "said"))
    both = said.withColumn("said", F.lower("said")).join(steps, "user").withColumn("step", F.lower("name"))
    own = T.content_set(F.col("step"))
    share = F.size(F.array_intersect(T.content_set(F.col("said")), own)) / F.greatest(F.lit(1), F.size(own))
    scored = both.withColumn("score", F.round(F.greatest(sequence_ratio("said", "step"), share), 6)).where(F.col("score") >= least)
    return scored.groupBy("user", "msg_id", "n").agg(F.max_by(F.struct("step_no", "name", "score"), F.struct("score", -F.col("step_no"))).alias("best")).select("user", "msg_id", "best.*")


def working_cap(items: DataFrame, session: str, order: list[str], cap: int = DEFAULT.working_max_items) -> DataFrame:
    """W7 with the item cap alone: what stays is the best by priority, then the latest."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("priority"), *[F.desc(c) for c in order]))
    return items.withColumn("place", rank).where(F.col("place") <= cap)


def evict(items: list[tuple], cap: int, budget: int) -> list[tuple]:
    """W7 in order: items are (priority, ts, tokens, ...); drops the least until both limits hold, but keeps one."""
    items = list(items)
    while len(items) > cap or (len(items) > 1 and sum(i[2] for i in items) > budget):
        items.remove(min(items, key=lambda i: i[:2]))
    return items


def build_prompt(sections: list[str], caps: dict[str, int], columns: dict[str, Column], message: Column, budget: int, system_tokens: int) -> dict[str, Column]:
    """Each section in order gets the lesser of its cap and what is left. One fold over an array of (name, cap, body)."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(caps[n]).alias("cap"), F.trim(F.coalesce(columns[n], F.lit(""))).alias("body")) for n in sections])
    start = F.struct((F.lit(budget) - system_tokens - T.count_tokens(message)).alias("left"), F.array().cast("array<struct<name:string,body:string,tokens:int>>").alias("done"))

    def step(a, x):
        cap = F.least(x["cap"], F.greatest(F.lit(0), a["left"]))

        def put(body):
            n = T.count_tokens(body)
            return F.struct((a["left"] - n).alias("left"), F.array_append(a["done"], F.struct(x["name"].alias("name"), body.alias("body"), n.alias("tokens"))).alias("done"))

        return F.when((x["body"] == "") | (cap <= 0), a).otherwise(T.let(T.truncate_to_tokens(x["body"], cap), put))

    done = F.aggregate(entries, start, step)["done"]
    prompt = F.concat(F.array_join(F.transform(done, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), s["body"], F.lit("\n\n"))), ""), F.lit("## Current user message\n"), message)
    total = F.aggregate(done, F.lit(0), lambda a, s: a + s["tokens"]) + system_tokens + T.count_tokens(message)
    return {"prompt": prompt, "total_tokens": total, "section_tokens": F.transform(done, lambda s: F.struct(s["name"], s["tokens"]))}
