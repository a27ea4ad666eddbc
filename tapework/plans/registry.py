"""All registered queries of the library (without the llm subpackage)."""

from __future__ import annotations

from . import decision_queries, evaluation_queries, interval_queries, live_queries, sanitize_queries, segmentation_queries, text_queries

MODULES = [interval_queries, decision_queries, text_queries, evaluation_queries, segmentation_queries, live_queries, sanitize_queries]


def queries() -> dict:
    """Query name to callable(spark, sf_dir)."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
