"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from corpalith.plans import answers, flows, jobs, measures, packing, pieces, queries, reports, search, store, writes  # noqa: F401  (each registers its queries)

QUERIES = queries.QUERIES
ORACLE_SQL = queries.SQL
FLAGSHIP = "a2_scope_diff"
