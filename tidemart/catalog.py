"""All queries of the warehouse and their SQL, by name."""

from __future__ import annotations

from tidemart.plans.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
