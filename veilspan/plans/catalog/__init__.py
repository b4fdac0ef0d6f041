"""Queries over the given tables, each with SQL that says the same in another engine."""

from __future__ import annotations

from . import detection, redaction, reports, responses, segments, speech  # noqa: F401
from .registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
