"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import answer_queries, report_queries, retrieval_queries, run_queries, source_queries, statistics_queries, timeline_queries  # noqa: F401  (they register themselves)
from .registration import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
