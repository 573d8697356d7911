"""Registered queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

from turnout.catalog import cohorts, composed, counting, ingest, logs, ranking, streams, writing  # noqa: F401  (register)
from turnout.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
