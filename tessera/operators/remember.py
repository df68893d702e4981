"""Write-ordered state by user or session (M3, M14): what depends on what was kept before runs in order inside its group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT
from ..functions import text as T
from .embedding import embed_words
from .sessions import evict


def apply_write(store: list[dict], text: str, words: list[str], kind: str, importance: float, slot: str | None, threshold: float, dim: int) -> str:
    """One write to a user's memories, in place: superseded, merged or written."""
    vec = embed_words(words, dim)

    def merge(m):
        m["access_count"] += 1
        m["importance"] = min(1.0, max(m["importance"], importance) + 0.05)
        return "merged"

    same_slot = next((m for m in store if slot and m["slot"] == slot), None)
    if same_slot:
        if same_slot["text"].strip().lower() == text.strip().lower():
            return merge(same_slot)
        same_slot["history"].append(same_slot["text"])
        same_slot.update(text=text, vec=vec, importance=max(same_slot["importance"], importance))
        return "superseded"
    like = max(store, key=lambda m: float(m["vec"] @ vec), default=None)
    if like is not None and float(like["vec"] @ vec) >= threshold:
        return merge(like)
    store.append({"text": text, "vec": vec, "kind": kind, "importance": importance, "slot": slot, "history": [], "access_count": 0})
    return "written"


def remember(writes: DataFrame, user: str, order: list[str], text: str, threshold: float = DEFAULT.dedup_threshold, dim: int = DEFAULT.embed_dim) -> DataFrame:
    """M3: each user's memories after all writes: user, text, kind, slot, importance, access_count, history."""
    kind = writes.schema[user].dataType.simpleString()
    rows = writes.select(F.col(user).alias("user"), F.struct(*order, F.col(text)).alias("at"), F.col(text).alias("text"), T.content_tokens(F.col(text)).alias("words"), "kind", "importance", "slot")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.iloc[sorted(range(len(group)), key=lambda i: tuple(group["at"].iloc[i].values()))]
        store: list[dict] = []
        for r in group.itertuples():
            apply_write(store, r.text, list(r.words), r.kind, r.importance, r.slot, threshold, dim)
        return pd.DataFrame([{"user": group["user"].iloc[0], "text": m["text"], "kind": m["kind"], "slot": m["slot"], "importance": round(m["importance"], 6), "access_count": m["access_count"], "history": " | ".join(m["history"])} for m in store])

    return rows.groupBy("user").applyInPandas(run, f"user {kind}, text string, kind string, slot string, importance double, access_count long, history string")


def working_memory(items: DataFrame, session: str, order: str, cap: int, budget: int) -> DataFrame:
    """What a session's working memory holds after its last item, and how many were evicted."""
    kind = items.schema[session].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        held, evicted = [], 0
        for r in group.sort_values(order).itertuples():
            held.append((int(r.priority), int(getattr(r, order)), int(r.tokens)))
            kept = evict(held, cap, budget)
            evicted += len(held) - len(kept)
            held = kept
        return pd.DataFrame({session: [group[session].iloc[0]], "items": [len(held)], "tokens": [sum(h[2] for h in held)], "evictions": [evicted], "turns": [",".join(str(h[1]) for h in held)]})

    return items.select(session, order, "priority", "tokens").groupBy(session).applyInPandas(run, f"{session} {kind}, items long, tokens long, evictions long, turns string")
