"""Queries by name, and their SQL for comparison."""

from __future__ import annotations

from panelcast.plans import fits, reports  # noqa: F401
from panelcast.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
