"""The queries over the tables and the SQL that states what they return."""

from __future__ import annotations

from . import analytics, retrieval, texts, upkeep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (retrieval, analytics, texts, upkeep):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
