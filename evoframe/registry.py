"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from evoframe.plans import derived, fixtures, queries

QUERIES: dict = queries.QUERIES | fixtures.QUERIES | derived.QUERIES
ORACLE: dict[str, str] = queries.ORACLE | fixtures.ORACLE | derived.ORACLE
