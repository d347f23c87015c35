"""All queries of the engine and their SQL."""

from __future__ import annotations

from tracelake.plans import detector_queries, event_queries, rate_queries, relation_queries, source_queries, stream_queries, trace_queries  # noqa: F401
from tracelake.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "tot_summary"
