"""All queries by name with the SQL that gives the same rows."""

from __future__ import annotations

from . import claims, codes, deliveries, events, formats, inspections, linkage, lookups, messages, streams, upkeep  # noqa: F401  they register their queries
from .register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
