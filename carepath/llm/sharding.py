"""Shards of near-equal bytes by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts stand together. A
size-weighted sample of keys gives the boundaries of many fine ranges; the exact
rows and bytes of every range are then counted in one aggregation. Ranges that
hold too many rows are sampled again by row and subdivided, as often as it takes; a
range that a sample does not split is cut at its greatest key, so every pass makes
progress until a range is small or one key. A hot group of equal texts is subdivided by id.
Shard k begins with the first record before which k/n of all bytes lie, so the
outcome depends on the data alone, not on the sample: shards differ from each other by
less than two records.

What passes through the driver are range boundaries and counts: a few per
``range_rows`` rows, and that size grows with the table so that ``MAX_RANGES`` bounds their number (some 50 bytes
each; the offsets that are broadcast are as many rows of 24 bytes).

Defined cases: a null text has size 1 like an empty one; a null id sorts first;
rows that are alike in id and text are counted as one key with a multiplicity and
dealt out one by one at the end; an empty table gives an empty table; only the id
and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import map_arrow, staged

LAW = "bytes"
RANGE_ROWS = 20_000
#: Ranges wanted at most; a table of more rows has larger ranges.
MAX_RANGES = 100_000
#: Sample draws per wanted range.
OVERSAMPLE = 8
#: Copies of one row (id and text alike) that one task writes out.
COPIES = 10_000
_SCALE = float(1 << 63)


def _locate(h: np.ndarray, i: np.ndarray, bh: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Number of boundaries (bh, bi) at or before each key (h, i); both ordered."""
    lo, hi = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    out = hi.copy()
    for row in np.flatnonzero(lo != hi):
        out[row] = lo[row] + np.searchsorted(bi[lo[row]:hi[row]], i[row], "right")
    return out


def _ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``rows`` with the number of its range between the cuts."""
    bh, bi = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((bh, bi))

    def run(batch):
        h, i = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "i"))
        found = pa.array(_locate(h, i, *shared.value), pa.int64())
        yield pa.RecordBatch.from_arrays(list(batch.columns) + [found], names=batch.schema.names + ["range"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return map_arrow(rows, run, f"{fields}, range long")


def _sample(rows: DataFrame, weight: Column, total: int, draws: int, seed: int) -> list[tuple[int, int]]:
    """Keys drawn with a probability in proportion to ``weight``, in order, ``draws`` of them on average."""
    chance = F.least(F.lit(1.0), weight * F.lit(draws / max(1, total)))
    coin = F.abs(F.xxhash64("h", "i", F.lit(seed)).cast("double")) / F.lit(_SCALE)
    got = rows.where(coin < chance).select("h", "i").distinct().collect()
    return sorted((r.h, r.i) for r in got)


def _quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []


def _measure(rows: DataFrame, cuts: list) -> dict[int, tuple[int, int, int]]:
    """Keys, bytes and rows per range."""
    got = _ranged(rows, cuts).groupBy("range").agg(F.count("*").alias("k"), F.sum("size").alias("b"), F.sum("n").alias("n"))
    return {r.range: (r.k, r.b, r.n) for r in got.collect()}


def _ranges(rows: DataFrame, n_keys: int, total: int, shards: int, range_rows: int) -> tuple[list, dict]:
    """Cuts between ranges of at most 2 * range_rows keys, and the measures of these very ranges."""
    fine = max(64 * shards, math.ceil(n_keys / range_rows))
    cuts = _quantiles(_sample(rows, F.col("size"), total, OVERSAMPLE * fine, 0), fine)
    counts, turn = _measure(rows, cuts), 0
    while wide := sorted(r for r, (k, _, _) in counts.items() if k > 2 * range_rows):
        turn += 1
        part = _ranged(rows, cuts).where(F.col("range").isin(wide))
        n = sum(counts[r][0] for r in wide)
        parts = 2 * math.ceil(n / range_rows)
        more = _quantiles(_sample(part, F.lit(1.0), n, OVERSAMPLE * parts, turn), parts)
        if not set(more) - set(cuts):
            ends = part.groupBy("range").agg(F.min(F.struct("h", "i")).alias("lo"), F.max(F.struct("h", "i")).alias("hi"))
            more = [(r.hi.h, r.hi.i) for r in ends.collect() if r.lo != r.hi]
            if not set(more) - set(cuts):      # ranges of one key: nothing is left to cut
                break
        cuts = sorted(set(cuts) | set(more))
        counts = _measure(rows, cuts)
    return cuts, counts


def assign(docs: DataFrame, shards: int = 8, *, range_rows: int = RANGE_ROWS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h, shard, slot) for every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"),
        (F.octet_length(text) + 1).cast("long").alias("each"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"))
    rows = staged(read.groupBy("doc_id", "i", "each", "text_crc32", "h").agg(F.count("*").alias("n"))
                  .withColumn("size", F.col("each") * F.col("n")), "shard-keys")
    n_keys, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cuts, counts = _ranges(rows, n_keys, total, shards, max(range_rows, math.ceil(n_keys / MAX_RANGES)))
    offsets, at_rows, at_bytes = [], 0, 0
    for r in sorted(counts):
        offsets.append((r, at_rows, at_bytes))
        at_rows, at_bytes = at_rows + counts[r][2], at_bytes + counts[r][1]
    before = rows.sparkSession.createDataFrame(offsets, "range long, rows0 long, bytes0 long")
    earlier = Window.partitionBy("range").orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (_ranged(rows, cuts).withColumn("bytes", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
              .withColumn("row", F.coalesce(F.sum("n").over(earlier), F.lit(0))))

    def offset(c: str) -> Column:
        return F.coalesce(c, F.raise_error(F.lit("a range has no offset")).cast("long"))
    keys = ranked.join(F.broadcast(before), "range", "left").select(
        "doc_id", "each", "text_crc32", "h", "n", (offset("bytes0") + F.col("bytes")).alias("bytes"),
        (offset("rows0") + F.col("row")).alias("row"))
    placed = staged(_copies(keys).withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"bytes * {shards} div {max(1, total)}")).cast("int")), "shard-rows")
    first = placed.groupBy("shard").agg(F.min("row").alias("row0"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", F.col("each").alias("size"), "text_crc32", "h", "shard",
        (F.col("row") - F.col("row0")).cast("long").alias("slot"))


def _copies(keys: DataFrame) -> DataFrame:
    """One row per copy of a key, with the bytes and rows before it; many copies are spread over tasks first."""
    columns = ["doc_id", "each", "text_crc32", "h"]

    def dealt(df, first, last):
        at = F.explode(F.sequence(first, last)).alias("c")
        return df.select(*columns, "bytes", "row", at).select(
            *columns, (F.col("bytes") + F.col("c") * F.col("each")).alias("bytes"), (F.col("row") + F.col("c")).alias("row"))

    few = keys.where(F.col("n") <= COPIES)
    many = (keys.where(F.col("n") > COPIES)
            .withColumn("b", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("h", "b"))
    start = F.col("b") * COPIES
    return dealt(few, F.lit(0).cast("long"), F.col("n") - 1).unionByName(
        dealt(many, start, F.least(start + COPIES, F.col("n")) - 1))


def report(docs: DataFrame, shards: int = 8) -> DataFrame:
    return assign(docs, shards).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
                                       F.lit(None).cast("int").alias("grown_shard"))
