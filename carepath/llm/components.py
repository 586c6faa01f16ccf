"""Connected components of an edge table with a few shuffles.

Edges are first merged by union-find inside each partition, which leaves one
edge per node and partition; the remaining forest is contracted by alternating
large-star and small-star steps (Kiveris et al., 2014), each one partial
aggregation and one join, until nothing changes. Nodes with very many edges, as the root of a
large group has, are joined by broadcast, so their edges stay where they are. Every step is written to the
shared folder, so a lost executor costs one step at most, and no edge list ever
sits in one task or the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import join_counted, staged


def _merge_partition(batches):
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    out = [(x, find(x)) for x in list(parent) if find(x) != x]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()),
                                          pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
                 .select("u", F.least("u", "m").alias("m"), "n"), "cc-low")
    return join_counted(both.where("v > u"), low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    down = staged(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-down")
    low = staged(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "cc-low")
    return (join_counted(down, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u != v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the (u, v) long edges; root is the smallest node reachable."""
    e = staged(edges.select("u", "v").where("u != v").mapInArrow(_merge_partition, "u long, v long"), "cc")
    before = None
    while True:
        e = staged(_small_star(_large_star(e)).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
