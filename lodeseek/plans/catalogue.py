"""All queries of the core and the SQL each is checked against."""

from __future__ import annotations

from lodeseek.plans import engine_queries, engine_sql, orphan_queries

_MODULES = [orphan_queries, engine_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return orphan_queries.ORACLE | engine_sql.ORACLE
