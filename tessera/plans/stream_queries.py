"""Queries that run as streams over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as S
from ..functions import text as T
from ..shared import shared_dir
from .registry import eviction, n_tokens, query


def _checkpoint(spark) -> str:
    return f"{shared_dir(spark)}/streams"


_GAPS = """g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g)"""


@query("stream_sessionise", f"WITH {_GAPS} SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sess")
def stream_sessionise(spark, sf_dir):
    """Sessions of events by event time."""
    return S.drain(S.sessions(S.stream(spark, sf_dir, "events.parquet")), "complete", _checkpoint(spark))


@query("stream_last_write", "SELECT user_id, event_type AS slot, arg_max(value, (ts, event_id)) AS value, count(*) AS writes FROM events GROUP BY ALL")
def stream_last_write(spark, sf_dir):
    """Last-write-wins slots."""
    return S.drain(S.last_values(S.stream(spark, sf_dir, "events.parquet")), "complete", _checkpoint(spark))


@query("stream_working_memory", f"WITH RECURSIVE i AS (SELECT conv_id AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn AS pos, CASE role WHEN 'user' THEN 2 ELSE 1 END AS priority, {n_tokens('text')} AS tokens FROM conversations), {eviction('i')} SELECT session, len(s)::BIGINT AS items, list_sum(list_transform(s, lambda x: x.t))::BIGINT AS tokens, gone::BIGINT AS evictions FROM held")
def stream_working_memory(spark, sf_dir):
    """W7 online: a working memory for each conversation."""
    turns = S.stream(spark, sf_dir, "conversations.parquet")
    items = turns.select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.when(F.col("role") == "user", 2).otherwise(1).alias("priority"), T.count_tokens(F.col("text")).alias("tokens"))
    return S.drain(S.working_memory(items), "update", _checkpoint(spark))
