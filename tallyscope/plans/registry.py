"""All registered queries and SQL twins."""

from __future__ import annotations

from tallyscope.plans import catalog_queries, census_queries, event_queries, reading_queries, screening_queries, synthetic_queries, table_queries

_GROUPS = (reading_queries, screening_queries, census_queries, table_queries, synthetic_queries, catalog_queries, event_queries)


def queries() -> dict:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: text for group in _GROUPS for name, text in group.ORACLE.items()}
