"""Registered queries and their SQL, by topic."""

from __future__ import annotations

from . import aggregates, changes, dialects, joins, jsons, more, numbers, scalars, search, statements, times, windows  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
