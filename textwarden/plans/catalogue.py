"""All queries of the library's own operators."""

from __future__ import annotations

from textwarden.plans import detection, records, reports, reshaping, responses, scanning, sessions, traffic  # noqa: F401  registers its queries
from textwarden.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
