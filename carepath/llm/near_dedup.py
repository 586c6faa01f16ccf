"""Near-duplicate classes: SuperMinHash signatures, banding, verification, union-find.

1. Each text becomes its set of distinct word shingles and a SuperMinHash
   signature (Ertl, 2017): element by element a pseudo-random permutation deals
   ranks to the components, and a text is finished as soon as no later rank can
   lower any of its components.
2. Texts with equal sets share one node (their smallest doc_id); copies are
   collapsed by a partial aggregation before anything else is shuffled.
3. Bands of the signature put nodes into buckets. In each bucket a pseudo-random
   leader is compared with all members, in several rounds with new leaders; once
   these have joined most members into components, the members of one bucket
   that still lie in different components are all compared, block by block.
   So pairs grow with a bucket's size, and no candidate is left unchecked
   unless its link could not change a component.
4. Candidates are verified on the full shingle sets, recomputed from the texts.
5. Links are merged by ``components``.

The number of bands follows from the threshold: a pair right at it shares no
bucket with probability ``miss`` at most (default 1e-6).

Defined cases: a text that is null or has no words has an empty set, links to
nothing and is kept; a row with a null id gets a null class and is kept; rows
that share an id form one node and so one class; a table without rows gives one
without rows. Only the id and text columns are read, so other columns cannot
clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import SLICE_BYTES, map_arrow, small_side, staged, text_slices
from carepath.llm.components import components
from carepath.llm.textnum import bounds, mix, shingle_sets

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)
_LOW32 = _U(0xFFFFFFFF)
#: Elements whose permutations are held at a time (times signature length, two bytes each).
_BLOCK = 25_000
#: Pairs whose texts are held at a time.
PAIRS = 400
#: Text of one block in the comparison of blocks.
BLOCK_BYTES = 64 * 1024
_UNSET = _U(0xFFFFFFFFFFFFFFFF)


def bands_for(similarity: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows))


def _draw(value: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank fraction (32 bits) and swap position in j..m-1 of each element at step j."""
    with np.errstate(over="ignore"):
        x = mix(value + _U(j + 1) * _GOLDEN)
    return x >> _U(32), _U(j) + (((x & _LOW32) * _U(m - j)) >> _U(32))


def super_min_hash(doc: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """(n, m) signatures of ``n`` sets given as (text, value) ordered by text; step in the
    upper 32 bits and rank fraction in the lower ones. Rows of empty sets stay unset."""
    sig = np.full(n * m, _UNSET, dtype=_U)
    if not len(doc):
        return sig.reshape(n, m)
    r, k = _draw(value, 0, m)
    np.minimum.at(sig, doc * m + k.astype(np.int64), r)
    table = sig.reshape(n, m)
    open_doc = table.max(axis=1) >= (_U(1) << _U(32))
    rest = np.flatnonzero(open_doc[doc])
    while len(rest):
        take = rest[:_BLOCK]
        if len(rest) > _BLOCK and doc[take[0]] != doc[rest[_BLOCK]]:   # whole texts only
            take = take[doc[take] != doc[rest[_BLOCK]]]
        elif len(rest) > _BLOCK:
            take = rest[doc[rest] == doc[take[0]]]
        rest = rest[len(take):]
        _later_steps(sig, table, doc[take], value[take], m)
    return table


def _later_steps(sig, table, doc, value, m: int) -> None:
    perm = np.tile(np.arange(m, dtype=np.int16), (len(doc), 1))
    _, k = _draw(value, 0, m)
    rows = np.arange(len(doc))
    k = k.astype(np.int64)
    perm[rows, k], perm[rows, 0] = 0, k
    for j in range(1, m):
        r, k = _draw(value, j, m)
        k = k.astype(np.int64)
        rows = np.arange(len(doc))
        at = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[rows, j]
        perm[rows, j] = at
        np.minimum.at(sig, doc * m + at, r + (_U(j) << _U(32)))
        go = (table.max(axis=1) >= (_U(j + 1) << _U(32)))[doc]
        if not go.any():
            return
        if go.mean() < 0.7:
            doc, value, perm = doc[go], value[go], perm[go]


def _band_values(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(np.arange(1, bands + 1, dtype=_U) * _GOLDEN, (len(sig), 1))
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out + sig[:, j:bands * rows:rows] * _U(2 * j + 3))
    return out.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): key of the whole set and one value per band; null and
    empty for an empty set."""
    m = bands * rows

    def run(batch):
        for part, texts in text_slices(batch, "t"):
            doc, value = shingle_sets(texts, shingle)
            edge = bounds(doc, len(texts))
            sig = _band_values(super_min_hash(doc, value, len(texts), m), bands, rows)
            count = np.diff(edge)
            keys = [xxhash.xxh3_128_digest(value[a:b].tobytes()) if b > a else None
                    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            full = count > 0
            offsets = np.concatenate(([0], np.cumsum(np.where(full, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(count, pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[full].ravel()))],
                names=["doc_id", "n_shingles", "set_key", "bands"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), run,
                     "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The (u, v) whose sets have intersection / union >= num / den."""
    a = docs.select(F.col("doc_id").alias("u"), F.col("t").alias("tu"))
    b = docs.select(F.col("doc_id").alias("v"), F.col("t").alias("tv"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.array("tu", "tv").alias("pair"))

    def run(batch):
        for i in range(0, batch.num_rows, PAIRS):
            yield from judged(batch.slice(i, PAIRS))

    def judged(batch):
        u, v = batch.column(0), batch.column(1)
        texts = [(t or "").encode() for p in batch.column(2).to_pylist() for t in p]
        start = 0
        while start < len(u):
            stop, size = start, 0
            while stop < len(u) and (size == 0 or size < SLICE_BYTES):
                size += len(texts[2 * stop]) + len(texts[2 * stop + 1])
                stop += 1
            doc, value = shingle_sets(texts[2 * start:2 * stop], shingle)
            n = stop - start
            total = np.bincount(doc // 2, minlength=n)
            order = np.lexsort((value, doc // 2))
            p, x = doc[order] // 2, value[order]
            shared = np.bincount(p[1:][(p[1:] == p[:-1]) & (x[1:] == x[:-1])], minlength=n)
            good = (total > shared) & (den * shared >= num * (total - shared))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([u.slice(start, n).filter(mask), v.slice(start, n).filter(mask)],
                                             names=["u", "v"])
            start = stop

    return map_arrow(both, run, "u long, v long")


def _leader_pairs(buckets: DataFrame, turn: int) -> DataFrame:
    """One pseudo-random leader per bucket against the members outside its component."""
    order = F.struct(F.xxhash64("h", "node", F.lit(turn)).alias("o"), "node", "root")
    lead = buckets.groupBy("h").agg(F.min(order).alias("lead"))
    return (buckets.join(lead, "h").where("root != lead.root")
            .select(F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v")).distinct())


def _matches(a: list[dict], b: list[dict], shingle: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links between two blocks of texts, without those that only close a ring."""
    both = a + b
    doc, value = shingle_sets([(x["t"] or "").encode() for x in both], shingle)
    kinds, at = np.unique(value, return_inverse=True)
    has = np.zeros((len(both), len(kinds)), dtype=np.float32)
    has[doc, at] = 1
    size = np.bincount(doc, minlength=len(both))
    shared = np.rint(has[:len(a)] @ has[len(a):].T).astype(np.int64)
    total = size[:len(a), None] + size[None, len(a):]
    rows, cols = np.nonzero((shared > 0) & (den * shared >= num * (total - shared)))
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        x, y = a[i], b[j]
        ra, rb = find(x["root"]), find(y["root"])
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((x["node"], y["node"]))
    return out


def _block_links(buckets: DataFrame, texts: DataFrame, shingle: int, num: int, den: int,
                 block_bytes: int | None = None) -> DataFrame:
    """All links between members of one bucket that still lie in different components.

    The component with most members of a bucket is its main one; all buckets with one main component
    form a group. The members outside it are strays. Blocks of strays are compared with blocks of the
    group's members, so a row holds two blocks of bounded size and pairs are never rows.
    """
    count = buckets.groupBy("h", "root").agg(F.count("*").alias("n"))
    main = count.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("g"))
    group = buckets.join(main, "h").select("g", "node", "root").distinct()
    held = staged(group.join(texts, group.node == texts.doc_id).select(
        "g", "node", "root", "t", (F.col("root") != F.col("g")).alias("stray")), "near-open-texts")
    size = held.groupBy("g", "stray").agg(F.sum(F.octet_length("t") + 64).alias("bytes"))
    dealt = held.join(size, ["g", "stray"]).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.ceil(F.col("bytes") / (block_bytes or BLOCK_BYTES))))
    blocks = staged(dealt.groupBy("g", "stray", "block").agg(F.collect_list(F.struct("node", "root", "t")).alias("docs")),
                    "near-blocks")
    strays = blocks.where("stray").select("g", F.col("block").alias("block_a"), F.col("docs").alias("docs_a"))
    pairs = (strays.join(blocks, "g").where("not stray or block_a <= block")
             .repartition("g", "block_a", "stray", "block").select("docs_a", "docs"))

    def run(batch):
        for i in range(batch.num_rows):
            found = _matches(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), shingle, num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                                  pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return map_arrow(pairs, run, "u long, v long")


def _open_buckets(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets with their members' present components; those inside one component go."""
    now = buckets.join(roots, "node", "left").select("h", "node", F.coalesce("root", "node").alias("root"))
    mixed = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    return now.join(mixed, "h")


def classes(docs: DataFrame, *, shingle: int = 5, similarity: tuple[int, int] = (80, 100), rows: int = 5,
            miss: float = 1e-6, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links; a pair is linked if
    den * |intersection| >= num * |union| with ``similarity`` = (num, den).
    """
    num, den = similarity
    bands = bands_for(num / den, rows, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    sets = staged(signatures(docs, shingle, bands, rows, id_col, text_col), "near-sets")

    named = sets.where("doc_id is not null and set_key is not null")
    nodes = staged(named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")),
                   "near-nodes")
    in_band = nodes.select(F.explode("bands").alias("h"), "node")
    shared = in_band.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("h")
    buckets = staged(in_band.join(shared, "h"), "near-buckets")
    members = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = staged(texts.join(small_side(members, 16), "doc_id", "left_semi").distinct(), "near-texts")

    # rows of one id are one node: its sets hang together
    own = named.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo != hi")
    found = (named.select("doc_id", "set_key").join(own.select("doc_id"), "doc_id", "left_semi")
             .join(nodes.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("u"), F.col("node").alias("v")))

    open_ = buckets.withColumn("root", F.col("node"))
    for turn in range(rounds + 1):
        if turn < rounds:
            links = _verified(_leader_pairs(open_, turn), texts, shingle, num, den)
        else:
            links = _block_links(open_, texts, shingle, num, den)
        roots = components(found.select("u", "v").union(links.select("u", "v")))
        found = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        if turn < rounds:
            open_ = staged(_open_buckets(buckets, roots), "near-open")
            if open_.isEmpty():
                break

    label = (nodes.select("set_key", "node").join(roots, "node", "left")
             .select("set_key", F.coalesce("root", "node").alias("component_id")))
    out = sets.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one per class, its smallest id. Rows that repeat a kept
    id are copies of it, of which the one with the smallest hash of all its columns stays."""
    judged = staged(classes(docs, id_col=id_col, text_col=text_col, **how).where("doc_id is not null")
                    .groupBy(F.col("doc_id").alias("_id"))
                    .agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")), "near-judged")
    ids = F.col(id_col).cast("long")
    leave = small_side(judged.where("not _kept or _n > 1").select("_id"), 16)
    repeated = small_side(judged.where("_kept and _n > 1").select("_id"), 16)
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    whole = F.struct(*docs.columns).alias("_row")
    once = (docs.join(repeated, ids == F.col("_id"), "left_semi").groupBy(ids.alias("_id"))
            .agg(F.min_by(whole, F.xxhash64(*plain)).alias("_row")).select("_row.*"))
    return docs.join(leave, ids == F.col("_id"), "left_anti").unionByName(once)
