"""Name → query and name → SQL text, gathered from the plan modules."""

from __future__ import annotations

from lexlake.plans import corpus_queries, dashboard_queries, graph_queries, matrix_queries, text_queries, version_queries

_MODULES = (text_queries, version_queries, graph_queries, corpus_queries, matrix_queries, dashboard_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
FLAGSHIP = "v4_diff_severity"
