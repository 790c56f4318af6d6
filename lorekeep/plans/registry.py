"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.engine.session import table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under ``name``; ``sql`` is what DuckDB runs to check it."""

    def add(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from lorekeep.plans import (  # noqa: F401  each module registers its queries
        batching_queries,
        card_queries,
        catalog_queries,
        context_queries,
        dedup_queries,
        diary_queries,
        facts_queries,
        hall_queries,
        ingest_queries,
        measure_queries,
        memory_queries,
        name_queries,
        note_queries,
        probe_queries,
        proposal_queries,
        reader_queries,
        registry_queries,
        retrieval_queries,
        search_queries,
        session_queries,
        skeleton_queries,
        spelling_queries,
        sync_queries,
        text_queries,
    )
