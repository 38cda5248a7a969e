"""All registered queries with their DuckDB SQL."""

from __future__ import annotations

from . import accounts, answers, corpus, machines, retrieval, search, sql

PARTS = [retrieval, search, answers, sql, machines, corpus, accounts]


def queries() -> dict:
    return {f.__name__: f for part in PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.SQL.items()}
