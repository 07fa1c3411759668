"""Registered queries: an operator over tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from . import compliance, entities, frames, fraud, labelled, mining, pii, records, streams, summaries, transcript, understanding  # noqa: F401
from .registry import SQL, all_queries


def all_sql() -> dict[str, str]:
    """The SQL of every query that has some."""
    return dict(SQL)


__all__ = ["all_queries", "all_sql"]
