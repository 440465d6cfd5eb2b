"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from . import cohort_queries, region_queries, report_queries, score_queries, source_queries

MODULES = (score_queries, cohort_queries, region_queries, report_queries, source_queries)

QUERIES = {k: v[0] for m in MODULES for k, v in m.ALL.items()}
SQL = {k: v[1] for m in MODULES for k, v in m.ALL.items() if v[1]}
