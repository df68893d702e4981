"""Query plans by area; importing them fills the registry."""

from . import assistant, memory_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
