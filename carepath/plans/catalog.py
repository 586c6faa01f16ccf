"""Registry of named queries and their SQL second opinions.

``queries()`` maps a name to ``fn(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` maps the same name to DuckDB SQL over the same tables.
Queries without an oracle (model training, attribution) are checked by
invariants in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carepath.plans import oracle

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE_BODIES: dict[str, str] = {}


def register(name: str, oracle_body: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle_body is not None:
            _ORACLE_BODIES[name] = oracle_body
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from carepath.plans import (feature_queries, ingest_queries, ml_queries,  # noqa: F401
                                notes_queries, serving_queries)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: oracle.sql(v) for k, v in _ORACLE_BODIES.items()}
