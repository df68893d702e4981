"""Online forms: sessions by event time, last writes, and a stateful working memory keyed by session.

State is bounded: session windows end by their watermark, a working memory holds at most its cap of items, and slots are one
row a (user, slot).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sessions import evict


def stream(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """A stream of Parquet tables of a folder; each may be a file or a folder of files."""
    schema = spark.read.parquet(f"{path}/{glob}").schema
    return spark.readStream.schema(schema).parquet(f"{path}/{{{glob}}}")  # in braces, as a stream takes one file by a pattern only


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events of a user without a gap are a session."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return s.select("user_id", F.unix_micros(F.col("w.start")).alias("start_us"), "n", "total")


def last_values(events: DataFrame) -> DataFrame:
    """Last value of each (user, slot): an aggregate whose state is one row a key."""
    return events.groupBy("user_id", F.col("event_type").alias("slot")).agg(F.max(F.struct("ts", "event_id", "value")).alias("m"), F.count(F.lit(1)).alias("writes")).select("user_id", "slot", F.col("m.value").alias("value"), "writes")


def working_memory(items: DataFrame, cap: int = 12, budget: int = 900) -> DataFrame:
    """items (session long, at long, priority int, tokens int): after each batch the state of the sessions that it touched."""

    def update(key, batches, state):
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at")
        gone = 0
        for r in rows.itertuples():
            held.append((int(r.priority), int(r.at), int(r.tokens)))
            kept = evict(held, cap, budget)
            gone += len(held) - len(kept)
            held = kept
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        yield pd.DataFrame({"session": [key[0]], "items": [len(held)], "tokens": [sum(h[2] for h in held)], "evictions": [gone]})

    return items.groupBy("session").applyInPandasWithState(update, "session long, items long, tokens long, evictions long", "priority array<int>, at array<long>, tokens array<int>", "update", "NoTimeout")


def drain(out: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what there is, into a table of the shared folder, and return its rows: the last result of a stream in complete mode,
    all rows of one in another mode. A batch that runs again replaces its own rows."""
    spark, name = out.sparkSession, f"drained-{uuid.uuid4().hex}"
    path = f"{checkpoint}/{name}/rows"
    last: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        last.append(batch)

    q = out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], out.schema)
    rows = spark.read.parquet(path) if mode != "complete" else spark.read.parquet(f"{path}/batch={max(last)}")
    return rows.select(*out.columns)
