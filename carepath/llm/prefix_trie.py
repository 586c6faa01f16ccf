"""Prefix trie of conversations over minimal-perfect-hash node tables.

A node is a distinct sequence of first turns. Its key is a 128-bit digest, chained
turn by turn, so the distinct digests of all prefixes are the nodes, and one partial aggregation
counts each node's conversations, however many share it. A node belongs to the smallest
conversation through it (its owner); on a conversation's path the owned nodes
are the last ones.

Sums over subtrees are made in shards. A shard holds the paths of a share of the
conversations, dealt by hash, so a common first turn is spread over all shards. In it the
distinct digests get the slots of a minimal perfect hash, verified against the stored digests
(``perfect_hash``); the owned nodes' counts are scattered into flat arrays by slot and
added up through the array of parent slots, deepest first. Sums are linear and
each node is owned once, so a node's total is the sum of its shards' parts.

Long conversations are cut twice: digests are chained in blocks of ``block`` turns and the
blocks' ends then chained with each other; paths are cut into bands of ``band`` turns
that are shards of their own, where what a path owns in later bands is added at the
band's last node. Turns of a conversation of more than ``long`` turns are numbered by a
range-partitioned rank. So no task holds a hot conversation, first turn or node. The digest over
a node's conversations is a running SHA-256 over id lists that were joined piecewise before, in order.

Defined cases: null role or text is empty; a null turn comes first; turns alike in
number are ordered by the digest of role and text; rows without a conv_id belong to no
conversation; a conversation without turns is a member of the root alone; an empty
table has no nodes; very long texts are hashed where they are read and never
shuffled; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carepath.llm.common import join_counted, staged
from carepath.llm.perfect_hash import PerfectHash
from carepath.operators.ranking import rank_within

BLOCK = 4096
BAND = 50_000
LONG = 100_000
SHARD_ROWS = 50_000
SHARDS = 64
#: Bytes of an id list that travels as one row.
LIST_BYTES = 64_000
ROOT = (0, 0)
_U = np.uint64
_NODE = "a long, b long"


def turns(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, pos, t, n_bytes, n): each turn's number from 0, its digest and bytes, and the turns of its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    read = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("t"),
        F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id is not null")
    read = staged(read, "trie-turns")
    sizes = staged(read.groupBy("conv_id").agg(F.count("*").alias("n")), "trie-sizes")
    few = sizes.where(F.col("n") > long).select("conv_id")      # at most 1 / long of all rows
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t")
    columns = ("conv_id", "pos", "t", "n_bytes")
    if few.isEmpty():
        placed = read.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).select(*columns)
    else:
        few = F.broadcast(few)
        placed = (read.join(few, "conv_id", "left_anti").withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
                  .select(*columns).unionByName(rank_within(read.join(few, "conv_id", "left_semi"), ["conv_id"],
                                                            ["turn", "t"], name="pos").select(*columns)))
    return placed.join(sizes, "conv_id")


def rebuilt(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (conv_id, depth, t, n_bytes, length) and (conv_id, length).

    Conversation c is the first h turns of conversation c - c % 5, then its own turns after its first h,
    with h = crc32(c as decimal text) % 9.
    """
    sizes = numbered.where("pos = 0").select("conv_id", "n")
    plan = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
                        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = staged(plan.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select(
        "conv_id", "base", "h", "taken", "length"), "trie-plan")
    own = numbered.join(plan, "conv_id").where("pos >= h").select(
        "conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "t", "n_bytes", "length")
    heads = numbered.where("pos < 8").select(F.col("conv_id").alias("base"), "pos", "t", "n_bytes")
    borrowed = plan.join(heads, "base").where("pos < h").select(
        "conv_id", (F.col("pos") + 1).alias("depth"), "t", "n_bytes", "length")
    return own.unionByName(borrowed), plan.select("conv_id", "length")


def plain(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the form of ``rebuilt``."""
    rows = numbered.select("conv_id", (F.col("pos") + 1).alias("depth"), "t", "n_bytes", F.col("n").alias("length"))
    return rows, rows.where("depth = 1").select("conv_id", "length")


def _chain(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` (with a binary ``t``) with the digest (a, b) of the t so far in their group and that before it (pa, pb).

    Rows come ordered by group, so a task holds one digest whatever the group's size.
    """
    def run(batches):
        group, state = None, b"\0" * 16
        for batch in batches:
            names = batch.schema.names
            marks = zip(*[batch.column(names.index(k)).to_pylist() for k in keys], strict=True)
            before, after = [], []
            for mark, t in zip(marks, batch.column(names.index("t")).to_pylist(), strict=True):
                if mark != group:
                    group, state = mark, b"\0" * 16
                before.append(state)
                state = hashlib.blake2b(state + t, digest_size=16).digest()
                after.append(state)
            both = [np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (after, before)]
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(np.ascontiguousarray(x[:, k])) for x in both for k in (0, 1)],
                names=names + ["a", "b", "pa", "pb"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(
        run, f"{fields}, a long, b long, pa long, pb long")


def _pair(a: str, b: str):
    """Two longs as the 16 bytes of a digest."""
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def prefixes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, n_bytes, length, a, b, pa, pb): the digest of each prefix and of its parent."""
    dealt = rows.withColumn("block", F.expr(f"(depth - 1) div {block}"))
    local = staged(_chain(dealt, ["conv_id", "block"], "depth").drop("t"), "trie-blocks")
    out = ["conv_id", "depth", "n_bytes", "length", "a", "b", "pa", "pb"]
    if local.where("block > 0").isEmpty():
        return local.select(out)
    # what precedes a block is the chain of the ends of the blocks before it
    ends = local.where((F.col("depth") % block == 0) & (F.col("depth") < F.col("length")))
    starts = _chain(ends.select("conv_id", "block", _pair("a", "b").alias("t")), ["conv_id"], "block").select(
        "conv_id", (F.col("block") + 1).alias("block"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    joined = local.where("block > 0").join(staged(starts, "trie-starts"), ["conv_id", "block"])
    first = F.expr(f"(depth - 1) % {block} = 0")

    def under(a, b):
        return F.unhex(F.substring(F.sha2(F.concat(_pair("sa", "sb"), _pair(a, b)), 256), 1, 32))

    def halves(d):
        # fifteen hexadecimal digits of each half: within a long
        return [F.conv(F.hex(F.substring(d, k, 8)).substr(2, 15), 16, 10).cast("long") for k in (1, 9)]
    tail = joined.withColumn("d", under("a", "b")).withColumn("p", under("pa", "pb"))
    (a, b), (pa_, pb_) = halves(F.col("d")), halves(F.col("p"))
    # the last node of the block before is the parent of the first: block 0 ends with its own digest, later ones with theirs
    last = joined.where(F.col("depth") % block == 0).withColumn("d", under("a", "b"))
    la, lb = halves(F.col("d"))
    ended = last.select("conv_id", (F.col("block") + 1).alias("block"), la.alias("ea"), lb.alias("eb")).unionByName(
        local.where(F.expr(f"block = 0 and depth = {block}")).select("conv_id", F.lit(1).cast("long").alias("block"),
                                                                     F.col("a").alias("ea"), F.col("b").alias("eb")))
    tail = (tail.select("conv_id", "block", "depth", "n_bytes", "length", a.alias("a"), b.alias("b"), pa_.alias("pa"), pb_.alias("pb"))
            .join(staged(ended, "trie-ends"), ["conv_id", "block"])
            .withColumn("pa", F.when(first, F.col("ea")).otherwise(F.col("pa")))
            .withColumn("pb", F.when(first, F.col("eb")).otherwise(F.col("pb"))))
    return local.where("block = 0").select(out).unionByName(tail.select(out))


def _accumulate(group: pa.Table) -> pa.Table:
    """Sums over the subtrees that a shard's owned nodes make up, per digest of the shard."""
    col = {c: group[c].to_numpy() for c in ("kind", "a", "b", "pa", "pb", "depth", "saved", "leaves", "inner")}
    a, b, pa_, pb_ = (col[c].view(_U) for c in ("a", "b", "pa", "pb"))
    inner = col["inner"] == 1          # the parent is part of this band
    keys = np.unique(np.stack([np.concatenate((a, pa_[inner])), np.concatenate((b, pb_[inner]))], axis=1), axis=0)
    table = PerfectHash(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
    n = len(keys)
    slot = table.slots(a, b)
    parent, depth = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    depth[slot] = col["depth"]
    parent[slot[inner]] = table.slots(pa_[inner], pb_[inner])
    saved, leaves, children = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(saved, slot, col["saved"])
    np.add.at(leaves, slot, col["leaves"])
    owned = col["kind"] == 1
    np.add.at(children, parent[slot[owned & inner]], 1)
    order = np.argsort(-depth, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        part = part[parent[part] >= 0]
        np.add.at(saved, parent[part], saved[part])
        np.add.at(leaves, parent[part], leaves[part])
    some = (saved != 0) | (leaves != 0) | (children != 0)
    above = owned & ~inner             # children of a node of the band before
    out = {"a": np.concatenate((table.a[some], pa_[above])).view(np.int64),
           "b": np.concatenate((table.b[some], pb_[above])).view(np.int64)}
    for name, x, more in (("saved", saved, 0), ("leaves", leaves, 0), ("children", children, 1)):
        out[name] = np.concatenate((x[some], np.full(int(above.sum()), more, np.int64)))
    return pa.table(out)


def subtree_sums(paths: DataFrame, nodes: DataFrame, *, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b, n_children, n_leaves, saved_tokens) of every node of the written tables."""
    shards = max(SHARDS, math.ceil(paths.count() / shard_rows))
    place = [F.pmod(F.xxhash64("conv_id"), F.lit(shards)).alias("shard"), F.expr(f"(depth - 1) div {band}").alias("band")]
    inner = F.when(F.expr(f"(depth - 1) % {band} <> 0 or depth = 1"), 1).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    value = ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")
    leaf = (F.col("n_convs") == F.col("n_ends")).cast("long").alias("leaves")
    links = ["a", "b", "pa", "pb", "depth"]
    owned = nodes.select(*place, F.lit(1).cast("long").alias("kind"), *links, value, leaf, inner.alias("inner"))
    walked = paths.select(*place, zero.alias("kind"), *links, zero.alias("saved"), zero.alias("leaves"), inner.alias("inner"))
    parts = owned.unionByName(walked)
    if not paths.where(F.col("depth") > band).isEmpty():
        later = nodes.select("conv_id", place[1], value, leaf).groupBy("conv_id", "band").agg(
            F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).where("band > 0")
        # what a path owns in band k counts at the last node of each band before
        later = later.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("band") - 1)).alias("band"),
                             "saved", "leaves").groupBy("conv_id", "band").agg(F.sum("saved").alias("saved"),
                                                                               F.sum("leaves").alias("leaves"))
        cut = paths.where(F.expr(f"depth % {band} = 0")).select("conv_id", place[0], place[1], *links, inner.alias("inner"))
        parts = parts.unionByName(cut.join(later, ["conv_id", "band"]).select(
            "shard", "band", zero.alias("kind"), *links, "saved", "leaves", "inner"))
    sums = parts.groupBy("shard", "band").applyInArrow(_accumulate, f"{_NODE}, saved long, leaves long, children long")
    return sums.groupBy("a", "b").agg(F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"),
                                      F.sum("saved").alias("saved_tokens"))


def _lists(batches):
    """Joins the ordered ids of a node to lists of about LIST_BYTES."""
    node, first, ids, size, out = None, None, [], 0, []

    def made():
        cols = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.binary()), strict=True)],
                                          names=["a", "b", "first", "ids"])
    for batch in batches:
        for a, b, c in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("a", "b", "conv_id")], strict=True):
            if (a, b) != node or size > LIST_BYTES:
                if ids:
                    out.append((*node, first, b",".join(ids)))
                node, first, ids, size = (a, b), c, [], 0
            ids.append(b"%d" % c)
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield made()
            out = []
    if ids:
        out.append((*node, first, b",".join(ids)))
    if out:
        yield made()


def _hashed(batches):
    """Running SHA-256 over a node's lists in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("a", "b", "ids")], strict=True):
            if (a, b) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        if out:
            yield _digests(out)
    if node is not None:
        yield _digests([(*node, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])],
                                      names=["a", "b", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv_id) rows: SHA-256 of the ascending ids, comma-joined."""
    lists = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(
        _lists, f"{_NODE}, first long, ids binary")
    return lists.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_hashed, f"{_NODE}, ends_sha256 string")


def trie(conversations: DataFrame, *, form=plain, block: int = BLOCK, band: int = BAND, long: int = LONG,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    rows, members = form(turns(conversations, long))
    paths = staged(prefixes(rows, block), "trie-paths")
    nodes = staged(paths.groupBy("a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("n_bytes").alias("n_bytes"),
        F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends")), "trie-nodes")
    zero = F.lit(0).cast("long")
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), "n_convs", "conv_id", zero.alias("depth"))
    top = staged(nodes.select("a", "b", "n_convs", "conv_id", "depth").unionByName(root), "trie-tops")
    parents = top.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"),
                         F.col("n_convs").alias("n"))
    below = join_counted(nodes.select("a", "b", "pa", "pb"), parents, ["pa", "pb"], "n").select("a", "b", "parent_conv_id")
    sums = subtree_sums(paths, nodes, band=band, shard_rows=shard_rows)
    ends = paths.where("depth = length").select("a", "b", "conv_id").unionByName(
        members.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    out = (top.join(below, ["a", "b"], "left").join(sums, ["a", "b"], "left").join(ends_digest(ends), ["a", "b"], "left"))
    # a root without nodes below it is its own leaf
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                      F.coalesce("n_leaves", zero + 1).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    return trie(conversations, form=rebuilt)


_CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT),
    lambda x, y: list_reduce([xor(x, y)] || range(0, 8), lambda z, k: xor(z >> 1, (z & 1) * 3988292384))), 4294967295)"""

ORACLE_SQL = f"""
WITH numbered AS (
  SELECT conv_id, sha256(strlen(role) || ':' || role || text) AS t, strlen(text) AS n_bytes,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM numbered GROUP BY conv_id),
plan AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h, n FROM sizes),
taken AS (SELECT p.*, least(p.h, coalesce(b.n, 0)) AS k FROM plan p LEFT JOIN sizes b ON b.conv_id = p.base),
built AS (
  SELECT p.conv_id, t.pos + 1 AS depth, t.t, t.n_bytes FROM taken p JOIN numbered t ON t.conv_id = p.base AND t.pos < p.h
  UNION ALL
  SELECT p.conv_id, p.k + t.pos - p.h + 1, t.t, t.n_bytes FROM taken p JOIN numbered t USING (conv_id) WHERE t.pos >= p.h),
paths AS (
  SELECT conv_id, depth, n_bytes, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM built
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM built) FROM plan),
nodes AS (
  SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * min(n_bytes) AS val,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends,
         left(node, 64 * (min(depth) - 1)) AS parent FROM paths GROUP BY node),
children AS (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
above AS (
  SELECT p.node AS top, n.val, c.n IS NULL AS leaf FROM nodes n
  JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children c ON c.parent = n.node),
sums AS (SELECT top, CAST(sum(val) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM above GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN children c ON c.parent = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent
"""
