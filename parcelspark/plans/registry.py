"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import check_queries, fit_queries, mean_queries, panel_queries, problems, summary_queries

QUERIES = {**problems.QUERIES, **panel_queries.QUERIES, **fit_queries.QUERIES, **check_queries.QUERIES, **mean_queries.QUERIES, **summary_queries.QUERIES}
SQL = {**problems.SQL, **panel_queries.SQL, **fit_queries.SQL, **check_queries.SQL, **mean_queries.SQL, **summary_queries.SQL}
FLAGSHIP = panel_queries.particle_score
