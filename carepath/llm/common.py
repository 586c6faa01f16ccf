"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.session import shared_path

#: Upper bound of one in-task slice of text; keeps numpy work arrays small whatever the batch size.
SLICE_BYTES = 250_000
#: Rows of one Arrow batch where the session does not say; texts are far larger than the columns Spark's default has in mind.
BATCH_ROWS = 1000
#: Bytes of one Arrow batch where the session does not say; a longer row makes a batch of its own.
BATCH_BYTES = 4 << 20
#: Setting, Spark's default, and the value taken instead of it.
_BATCH_CONFS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)),
                ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and
    later jobs neither recompute it nor depend on an executor's disk."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch into runs of rows of about ``SLICE_BYTES`` text; a null text is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    texts = col.cast(pa.large_binary())
    start, size = 0, 0
    lengths = [x or 0 for x in _lengths(texts)]
    for i, n in enumerate(lengths):
        if size and size + n > SLICE_BYTES:
            yield _cut(batch, texts, start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield _cut(batch, texts, start, len(lengths))


def _lengths(texts: pa.Array) -> list:
    import pyarrow.compute as pc
    return pc.binary_length(texts).to_pylist()


def _cut(batch, texts, a: int, b: int):
    return batch.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).to_pylist()]


def map_arrow(df: DataFrame, fn: Callable, schema: str, at_end: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over batches: ``fn(batch)`` yields record batches. ``at_end`` is called when a task
    ends; then its memory goes back to the system, as the worker is kept for later tasks. A session that has
    no batch size of its own gets ``BATCH_ROWS`` and ``BATCH_BYTES``."""
    session = df.sparkSession
    for conf, default, value in _BATCH_CONFS:
        if session.conf.get(conf, None) in (None, default) and session.sparkContext.getConf().get(conf) is None:
            session.conf.set(conf, value)

    def run(batches):
        try:
            for batch in batches:
                yield from fn(batch)
        finally:
            batch = None
            if at_end:
                at_end()
            _give_back()
    return df.mapInArrow(run, schema)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def within(df: DataFrame, max_rows: int) -> bool:
    """True if ``df`` has at most ``max_rows`` rows (reads no more than it needs)."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, row_bytes: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only for a side whose measured rows times ``row_bytes``
    stay under ``max_bytes``; beyond it the planner joins by shuffle."""
    return F.broadcast(df) if within(df, max_bytes // row_bytes) else df


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n: str, parts: int = 2000) -> DataFrame:
    """``rows`` joined to the written table ``keyed``, which has one row per key and in ``n`` the number of
    ``rows`` with it. Keys of more than a ``parts``-th of all rows (so at most ``parts`` of them) are
    broadcast and their rows never shuffled; the others are joined by shuffle."""
    total = keyed.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    bound = max(64, total // parts)
    hot, rest = keyed.where(F.col(n) > bound).drop(n), keyed.where(F.col(n) <= bound).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
