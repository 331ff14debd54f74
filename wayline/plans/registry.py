"""All queries of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from wayline.plans import case_queries, job_queries, trace_queries

_MODULES = [trace_queries, case_queries, job_queries]
QUERIES: dict = {n: q for m in _MODULES for n, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: q for m in _MODULES for n, q in m.ORACLE_SQL.items()}
