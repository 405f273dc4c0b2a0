"""Registered queries and their SQL twins, gathered from the query modules."""

from __future__ import annotations

from leafmill.plans import align_queries, evidence_queries, job_queries, layout_queries, markup_queries, page_queries, source_queries, state_queries, unit_queries  # noqa: F401  they register their queries
from leafmill.plans.registry import COVERS, ORACLES, QUERIES

#: The query that entry() runs.
FLAGSHIP = "page_fidelity_score"

__all__ = ["COVERS", "FLAGSHIP", "ORACLES", "QUERIES"]
