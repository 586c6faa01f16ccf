"""Boosted trees of large tables: Spark ML's ``GBTClassifier`` grown from column blocks.

Spark ML follows every row as an object, about 1 microsecond of a core per row and level. Here a partition is one block:
the features' bins (a byte each), label, weight and margin as numpy arrays. A level of a tree is one job that adds up
weights and residuals per (node, feature, bin) in each block; the driver adds the blocks' sums and picks the splits.
The trees are those of Spark ML: split candidates from a sample of its size by its rule, log loss with labels -1 and 1,
variance gain, the first best split of a node's drawn features, the first tree with weight 1 and the others with the step
size. Without bagging and feature draws they are equal up to rounding (tested); the draws use numpy's generators.

A block is rows x (features + 17) bytes, sums are nodes x features x bins numbers of a block, whatever its rows; beyond 64 partitions the sums are added in a tree. Margins are kept anew every ``KEEP`` rounds, in blocks computed
from the last kept ones and the trees since, so that lost blocks are computed again with the same draws.
"""

from __future__ import annotations

import gc
import json
import time
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carepath.session import shared_path

#: Rounds between two sets of kept margins.
KEEP = 8
#: Rows added up at once: their arrays stay in a core's cache.
CHUNK = 32_768
#: Deepest trees, and most bins, that a byte numbers.
MOST_DEPTH, MOST_BINS = 8, 256
_EPSILON = 2.0 ** -52


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i+1, 2i+2); ``feature`` is -1 where no split is."""
    feature: np.ndarray
    bin: np.ndarray         # rows with a bin up to this one go left
    value: np.ndarray
    stats: np.ndarray       # per node: weight, weighted sum and square sum of the residuals, rows
    gain: np.ndarray
    weight: float           # of the tree in the margin

    @classmethod
    def empty(cls, depth: int, weight: float) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.uint8), np.zeros(n), np.zeros((n, 4)), np.full(n, -1.0), weight)

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 1


def split_points(values: np.ndarray, weights: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of one feature: midpoints of neighbouring values, all or at strides of equal weight."""
    value, at = np.unique(values, return_inverse=True)
    middle = (value[:-1] + value[1:]) / 2.0
    if len(middle) < max_bins:
        return middle
    weight = np.bincount(at, weights)
    stride, seen, out = weight.sum() / max_bins, weight[0], []
    target = stride
    for i in range(1, len(value)):
        before, seen = seen, seen + weight[i]
        if abs(before - target) < abs(seen - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


# ------------------------------------------------------------ in the tasks
def _to_block(batches, cols: list[str], splits: list[np.ndarray]):
    """One row: the block of a partition's rows, if it has any. Their order depends on the rows alone, not on how they came,
    as rows are drawn by place."""
    bins, label, weight = [], [], []
    for b in batches:
        x = [b.column(c).to_numpy(zero_copy_only=False) for c in cols]
        if not all(np.isfinite(v).all() for v in x):
            raise ValueError("features must not be NaN or infinite")
        bins.append(np.array([np.searchsorted(s, v) for s, v in zip(splits, x, strict=True)], dtype=np.uint8).reshape(len(cols), -1))
        label.append(b.column("label").to_numpy(zero_copy_only=False))
        weight.append(b.column("weight").to_numpy(zero_copy_only=False))
    if sum(map(len, label)):
        x, y, w = np.concatenate(bins, axis=1), (2 * np.concatenate(label) - 1).astype(np.int8), np.concatenate(weight)
        order = np.lexsort((*x, y, w))[np.random.default_rng(len(y)).permutation(len(y))]
        data = b"".join(a.tobytes() for a in (x[:, order], y[order], w[order], np.zeros(len(y))))
        yield pa.RecordBatch.from_pydict({"rows": pa.array([len(y)], pa.int64()), "block": pa.array([data], pa.binary())})


def _from_row(features: int, part: int, rows):
    for r in rows:
        n, data = r.rows, r.block
        at = features * n
        yield (part, np.frombuffer(data, np.uint8, at).reshape(features, n), np.frombuffer(data, np.int8, n, at),
               np.frombuffer(data, np.float64, n, at + n), np.frombuffer(data, np.float64, n, at + 9 * n))


def _settle() -> None:
    """Sets a worker's loaded modules apart from its garbage collection, which Spark runs after each task: 40 ms of a
    core for the small tasks here."""
    if TaskContext.get() and not gc.get_freeze_count():
        gc.collect()
        gc.freeze()


def _route(bins: np.ndarray, tree: Tree, depth: int) -> np.ndarray:
    """Number within level ``depth`` of each row's node; below a leaf rows go left."""
    node = np.zeros(bins.shape[1], np.uint8)
    for level in range(depth):
        right = np.zeros(len(node), bool)
        first = 2 ** level - 1
        for k in range(first + 1):
            if tree.feature[first + k] >= 0:
                right |= (node == k) & (bins[tree.feature[first + k]] > tree.bin[first + k])
        node = node << 1 | right
    return node


def _leaf_values(tree: Tree) -> np.ndarray:
    """Per place in the last level the value of the leaf whose rows end there."""
    value = tree.value
    for level in range(tree.depth):
        first = 2 ** level - 1
        for i in range(first, 2 * first + 1):
            if tree.feature[i] < 0:
                value = value.copy() if value is tree.value else value
                value[2 * i + 1] = value[i]
    return value[2 ** tree.depth - 1:]


def _advance(block, trees: list[Tree]):
    """The block with the margins after ``trees``."""
    part, bins, y, w, margin = block
    margin = margin.copy()
    for tree in trees:
        values = _leaf_values(tree) * tree.weight
        for s in range(0, len(y), CHUNK):
            margin[s:s + CHUNK] += values[_route(bins[:, s:s + CHUNK], tree, tree.depth)]
    return part, bins, y, w, margin


def _draw(block, trees: list[Tree], first: bool, subsample: float, seed: int):
    """(bins, weights, weighted residuals) of the rows drawn for a tree; the first tree fits the labels."""
    part, bins, y, w, margin = _advance(block, trees)
    residual = y.astype(np.float64) if first else 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
    if subsample < 1.0:
        kept = np.flatnonzero(np.random.default_rng([seed, part]).random(len(y)) < subsample)
        bins, w, residual = bins.take(kept, axis=1), w[kept], residual[kept]
    return bins, w, w * residual


def _sums(drawn, tree: Tree, depth: int, slots: np.ndarray, n_slots: int, n_nodes: int, n_bins: int):
    """Statistics of the ``n_nodes`` nodes of a level that ``slots`` numbers, and for the first ``n_slots`` of them the sums
    of (weight, residual) per node, feature and bin."""
    _settle()
    bins, w, wr = drawn
    size = n_slots * n_bins
    per_bin = np.zeros((2, len(bins), size))
    stats = np.zeros((4, n_nodes + 1))                  # one more for rows of other nodes
    for s in range(0, len(w), CHUNK):
        b, cw, cr = bins[:, s:s + CHUNK], w[s:s + CHUNK], wr[s:s + CHUNK]
        slot = slots[_route(b, tree, depth)]
        for i, v in enumerate((cw, cr, cr * cr / cw, None)):
            stats[i] += np.bincount(slot, v, n_nodes + 1)
        if n_slots:
            asked = np.flatnonzero(slot < n_slots)
            if len(asked) < len(slot):
                b, cw, cr, slot = b.take(asked, axis=1), cw[asked], cr[asked], slot[asked]
            base = slot * n_bins
            for f in range(len(bins)):
                at = base + b[f]
                per_bin[0, f] += np.bincount(at, cw, size)
                per_bin[1, f] += np.bincount(at, cr, size)
    return per_bin.reshape(2, len(bins), n_slots, n_bins), stats[:, :-1].T


# ----------------------------------------------------------- in the driver
def _add(a, b):
    return a[0] + b[0], a[1] + b[1]


def _total(sums: RDD):
    if sums.getNumPartitions() > 64:
        return sums.treeReduce(_add)
    out = None
    for one in sums.collect():
        out = one if out is None else _add(out, one)
    return out


def _best_splits(per_bin: np.ndarray, stats: np.ndarray, n_splits: np.ndarray, drawn: list[np.ndarray]):
    """Per node the first (feature in the order drawn, bin) with the largest gain, and the gain (-inf: no split)."""
    w, s = per_bin                                                # feature, node, bin
    left_w, left_s = (x.cumsum(-1)[..., :-1] for x in (w, s))
    right_w, right_s = (x[..., ::-1].cumsum(-1)[..., -2::-1] for x in (w, s))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_s ** 2 / left_w + right_s ** 2 / right_w - (stats[:, 1] ** 2 / stats[:, 0])[:, None]) / stats[:, 0][:, None]
    usable = (left_w > 0) & (right_w > 0) & (np.arange(gain.shape[-1]) < n_splits[:, None, None])
    gain = np.where(usable, gain, -np.inf)
    for node, features in enumerate(drawn):
        g = gain[features, node]
        f, b = np.unravel_index(g.argmax(), g.shape)
        yield int(features[f]), int(b), float(g[f, b])


def _grow(drawn: RDD, depth: int, weight: float, n_splits: np.ndarray, n_bins: int, per_node: int, least: float, rng) -> Tree:
    """A tree of the drawn rows. Of two siblings only the lighter one's sums are added up; the other's are what is left of
    their parent's (``least``, the smallest weight of a row, tells what is left of no row)."""
    tree, nodes, light, parents = Tree.empty(depth, weight), [0], [0], {}
    for level in range(depth + 1):
        first, added = 2 ** level - 1, light if level < depth else []
        order = added + [i for i in nodes if i not in added]
        slots = np.full(2 ** level, len(nodes))
        slots[np.array(order) - first] = np.arange(len(nodes))
        per_bin, stats = _total(drawn.map(partial(_sums, tree=tree, depth=level, slots=slots, n_slots=len(added),
                                                  n_nodes=len(nodes), n_bins=n_bins)))
        tree.stats[order] = stats
        mean = stats[:, 1] / stats[:, 0]
        tree.value[order] = mean
        if level == depth:
            break
        sums = {i: per_bin[:, :, k] for k, i in enumerate(added)}
        for i in order[len(added):]:
            rest = parents[(i - 1) // 2] - sums[i + 1 if i % 2 else i - 1]
            sums[i] = np.where(rest[0] < least / 2, 0.0, rest)
        per_bin = np.stack([sums[i] for i in nodes], axis=2)
        features = [rng.permutation(len(n_splits))[:per_node] if per_node < len(n_splits) else np.arange(len(n_splits)) for _ in nodes]
        parents, below, light = {}, [], []
        for node, (f, b, gain) in zip(nodes, _best_splits(per_bin, tree.stats[nodes], n_splits, features), strict=True):
            w, s, ss, _ = tree.stats[node]
            if gain > 0 and abs(ss / w - (s / w) ** 2) >= _EPSILON:
                tree.feature[node], tree.bin[node], tree.gain[node] = f, b, gain
                parents[node] = sums[node]
                below += [2 * node + 1, 2 * node + 2]
                light.append(below[-2 if sums[node][0, f, :b + 1].sum() <= w / 2 else -1])
        nodes = below
        if not nodes:
            break
    return tree


def suits(gbt: GBTClassifier) -> bool:
    """Whether ``fit`` grows what ``gbt`` would: bytes hold its nodes and bins, and its other settings are the library's."""
    subset = gbt.getFeatureSubsetStrategy()
    return (gbt.getMaxDepth() <= MOST_DEPTH and gbt.getMaxBins() <= MOST_BINS and (subset == "all" or _is_share(subset))
            and gbt.getMinInstancesPerNode() == 1 and gbt.getMinInfoGain() == 0 and gbt.getMinWeightFractionPerNode() == 0)


def _is_share(text: str) -> bool:
    try:
        return "." in text and 0 < float(text) <= 1
    except ValueError:
        return False


def fit(gbt: GBTClassifier, train: DataFrame, cols: list[str], parts: int) -> GBTClassificationModel | None:
    """The model of ``gbt`` (see ``suits``) for the rows of ``train`` (``cols``, label, weight), dealt to ``parts`` blocks. None if
    a row weighs nothing or has a weight or label that Spark ML refuses."""
    seed, n_bins = gbt.getSeed(), gbt.getMaxBins()
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col("label").cast("double").alias("label"),
                        F.col("weight").cast("double").alias("weight"))
    w, y = F.col("weight"), F.col("label")
    n, usual, least = rows.agg(F.count(F.lit(1)), F.count_if((w > 0) & (w < float("inf")) & y.isin(0.0, 1.0)), F.min(w)).first()
    if usual < n:
        return None
    share = max(n_bins ** 2, 10_000) / n
    seen = (rows.sample(False, share, seed) if share < 1 else rows).toPandas()
    splits = [split_points(seen[c].to_numpy(), seen["weight"].to_numpy(), n_bins) for c in cols]
    n_splits = np.array([len(s) for s in splits])
    n_bins = max(2, int(n_splits.max()) + 1)
    subset = gbt.getFeatureSubsetStrategy()
    per_node = len(cols) if subset == "all" else max(1, int(np.ceil(float(subset) * len(cols))))

    kept = (rows.repartition(parts).mapInArrow(partial(_to_block, cols=cols, splits=splits), "rows long, block binary").rdd
            .mapPartitionsWithIndex(partial(_from_row, len(cols))).persist(StorageLevel.MEMORY_AND_DISK_DESER))
    trees: list[Tree] = []
    for m in range(gbt.getMaxIter()):
        last = None
        if m and m % KEEP == 0:
            last, kept = kept, kept.map(partial(_advance, trees=trees[m - KEEP:])).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        drawn = kept.map(partial(_draw, trees=trees[m - m % KEEP:], first=m == 0, subsample=gbt.getSubsamplingRate(),
                                 seed=seed + m)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        trees.append(_grow(drawn, gbt.getMaxDepth(), gbt.getStepSize() if m else 1.0, n_splits, n_bins, per_node,
                           least, np.random.default_rng([seed, m])))
        drawn.unpersist()
        if last is not None:
            last.unpersist()
    kept.unpersist()
    return _model(gbt, train.sparkSession, trees, splits)


def _node_rows(number: int, tree: Tree, splits: list[np.ndarray]):
    """A tree's rows in the table of nodes of a saved model; ids run by levels."""
    order, inner = [0], {}
    for i in order:
        if tree.feature[i] >= 0:
            inner[i] = len(order), len(order) + 1
            order += [2 * i + 1, 2 * i + 2]
    for k, i in enumerate(order):
        w, s, ss, n = tree.stats[i].tolist()
        f, at = (int(tree.feature[i]), [float(splits[tree.feature[i]][tree.bin[i]])]) if i in inner else (-1, [])
        yield number, (k, float(tree.value[i]), ss / w - (s / w) ** 2, [w, s, ss], int(n), float(tree.gain[i]),
                       *inner.get(i, (-1, -1)), (f, at, -1))


def _model(gbt: GBTClassifier, spark, trees: list[Tree], splits: list[np.ndarray]) -> GBTClassificationModel:
    """The trees as Spark ML's model, by way of its saved form."""
    def params(of, names=None):
        return {p.name: v for p, v in of.items() if names is None or p.name in names}

    given = {p: gbt.getOrDefault(p) for p in gbt.params if gbt.isSet(p)}
    usual = {p: gbt._defaultParamMap[p] for p in gbt.params if gbt.hasDefault(p)}
    of_tree = {"maxBins", "maxDepth", "seed", "weightCol", "featuresCol", "labelCol", "predictionCol", "leafCol", "impurity",
               "cacheNodeIds", "checkpointInterval", "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode"}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    whole = about | {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": gbt.uid, "paramMap": params(given),
                     "defaultParamMap": params(usual), "numFeatures": len(splits), "numTrees": len(trees)}
    each = about | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "paramMap": params(given, of_tree),
                    "defaultParamMap": params(usual, of_tree)}
    path = shared_path(spark, "boosted")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, json.dumps(each | {"uid": f"{gbt.uid}_{i}"}), float(t.weight)) for i, t in enumerate(trees)],
                          "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([r for i, t in enumerate(trees) for r in _node_rows(i, t, splits)], """treeID int, nodeData struct<id: int,
        prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, leftChild: int,
        rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>""") \
        .coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
