"""All of the engine's queries over the driver's tables, with their SQL."""

from __future__ import annotations

from turnstone.plans import card_queries, compaction_queries, control_queries, engagement_queries, evidence_queries, extra_queries, more_queries, olap, payload_queries, quote_queries, rank_queries, rollup_queries, sequence_queries, store_queries, stream_queries, text_queries, timeline_queries, upkeep_queries  # noqa: F401
from turnstone.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "v6_hybrid_topic_retrieval"
