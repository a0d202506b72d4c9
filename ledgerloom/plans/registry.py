"""All core queries by name."""

from __future__ import annotations

from . import core_problems, core_sql, sales_queries, sales_sql


def queries() -> dict:
    return sales_queries.QUERIES | core_problems.QUERIES


def oracle_sql() -> dict[str, str]:
    return sales_sql.SQL | core_sql.SQL
