"""Broadcast with a checked size bound, and dealing rows of few files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
#: Bytes of a value in a broadcast table, by kind; a text, list or struct counts as many.
_VALUE_BYTES = {"boolean": 8, "byte": 8, "short": 8, "integer": 8, "long": 8, "float": 8, "double": 8, "date": 8,
                "timestamp": 8, "timestamp_ntz": 8}
_OTHER_BYTES = 128


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row in memory, from the schema."""
    return 16 + sum(_VALUE_BYTES.get(f.dataType.typeName(), _OTHER_BYTES) for f in df.schema)


def sized_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after counting the side; beyond ``max_rows`` (or ``max_bytes`` by the schema's row size) the
    join is left to the planner (sort-merge, AQE skew handling). For small derived
    tables whose bound is structural (classes, partitions) but not a literal."""
    most = min(max_bytes // row_bytes(df), max_rows if max_rows is not None else max_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Deal the rows over ``parts`` tasks before a CPU-heavy per-row step; with none they stay where they are.

    For inputs of few large files; a large table has more splits than cores and is not dealt again."""
    return df.repartition(parts) if parts else df
