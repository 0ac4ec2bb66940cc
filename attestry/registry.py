"""All registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "r19_passage_verification"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL for the same rows if there is any."""

    def add(query: Query) -> Query:
        label = name or query.__name__
        _QUERIES[label] = query
        if sql:
            _SQL[label] = sql
        return query

    return add


def _load() -> None:
    from attestry import plans  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
