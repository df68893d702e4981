"""Tunables of retrieval, memory and context assembly."""

from __future__ import annotations

from dataclasses import dataclass


#: The limits, weights and sizes that results depend on.
@dataclass(frozen=True)
class Config:
    working_max_items: int = 12
    working_token_budget: int = 900
    working_item_tokens: int = 220
    session_recent_turns: int = 6
    session_compact_after: int = 10
    dedup_threshold: float = 0.90
    half_life_days: float = 30.0
    chunk_target_tokens: int = 160
    chunk_overlap_tokens: int = 30
    embedder: str = "hashing"
    embed_dim: int = 1024
    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    rerank_top_n: int = 12
    final_k: int = 4
    min_relevance: float = 0.20
    relative_floor: float = 0.5
    context_token_budget: int = 2400
    optimise_token_budget: int = 700
    near_dup_cosine: float = 0.85
    near_dup_jaccard: float = 0.7
    containment: float = 0.85
    upfront_knowledge_k: int = 2
    bm25_k1: float = 1.4
    bm25_b: float = 0.75


DEFAULT = Config()

#: Weights of the pair re-ranker's features.
RERANK_WEIGHTS = {"dense": 0.35, "sparse": 0.20, "coverage": 0.35, "heading": 0.10}

#: Caps of prompt sections in tokens, in the order in which they are filled.
SECTION_CAPS = {
    "Turn events": 120,
    "User profile & preferences": 120,
    "Task progress": 260,
    "Previous sessions": 220,
    "Long-term memories about this user": 220,
    "Pinned knowledge": 420,
    "Working memory": 300,
    "Conversation summary": 160,
    "Recent turns": 500,
    "Retrieved sources": 900,
}
