"""Registered queries: name -> callable, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from . import io, lexicon, matching, metrics, pairs, pipeline, search, severity, stream, text  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
