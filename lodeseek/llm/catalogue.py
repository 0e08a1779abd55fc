"""All queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

from lodeseek.llm import queries_packing, queries_pairs, queries_text

_MODULES = [queries_text, queries_pairs, queries_packing]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
