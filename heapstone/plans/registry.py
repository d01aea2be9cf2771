"""Queries of the diagnostic operators and their SQL."""

from __future__ import annotations

from heapstone.plans import aggregates, compared, joins, parsed, ranged, recorded, rules, texts, timelines, viewed  # noqa: F401
from heapstone.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
