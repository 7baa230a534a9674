"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import lake, matching, packed, streams, tables, text

_MODULES = (lake, matching, packed, streams, tables, text)
FLAGSHIP = matching.mentions_by_rule


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in _MODULES for k, v in getattr(m, "SQL", {}).items()}
