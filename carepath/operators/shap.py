"""Additive per-feature attributions for boosted-tree models (path-dependent TreeSHAP).

Algorithm: Lundberg, Erion & Lee, "Consistent Individualized Feature
Attribution for Tree Ensembles" (2018), Algorithm 2. The paths of a tree are
the same for every row — only the hot/cold indicator of each feature on a path
depends on the row — so a path's weights are worked out once per pattern of
indicators, and the rows of a whole Arrow batch look them up with numpy vectors.

The ensemble comes from the saved model's node table (Parquet). Its size is
bounded by the model parameters (trees x 2^(depth+1) nodes), not by the data,
so it is broadcast; patient rows stream through ``mapInPandas``.

Spark's boosted trees predict P(y=1) = sigmoid(2·margin), margin = Σ w_t·tree_t(x)
(first tree weight 1, the rest the step size), so log-odds attributions are
twice the margin ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.operators.joins import spread


# trees x 2^(depth+1) for the largest configured model (300 rounds, depth 6) is ~38k
MAX_ENSEMBLE_NODES = 5_000_000


@dataclass
class Tree:
    left: np.ndarray       # child index or -1
    right: np.ndarray
    feature: np.ndarray    # split feature or -1 on leaves
    threshold: np.ndarray
    value: np.ndarray      # leaf prediction
    cover: np.ndarray      # training rows reaching the node
    weight: float


def load_ensemble(spark: SparkSession, model_path: str) -> list[Tree]:
    """Trees of a saved GBT stage: reads ``data`` (nodes) and ``treesMetadata`` (weights)."""
    nodes = spark.read.parquet(f"{model_path}/data")
    n_nodes = nodes.count()
    if n_nodes > MAX_ENSEMBLE_NODES:
        raise ValueError(f"ensemble of {n_nodes} nodes is too large to broadcast")
    nodes = nodes.select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr")).toPandas()
    meta = spark.read.parquet(f"{model_path}/treesMetadata")
    # saved as an unnamed tuple table: (treeID, metadata json, weight)
    cols = meta.columns
    tid_col, w_col = ("treeID", "weights") if "treeID" in cols else (cols[0], cols[-1])
    meta = meta.select(F.col(tid_col).alias("treeID"), F.col(w_col).alias("weights")).toPandas()
    weights = dict(zip(meta.treeID, meta.weights))
    trees = []
    for tid, g in nodes.groupby("treeID"):
        g = g.sort_values("id")
        idx = {nid: i for i, nid in enumerate(g["id"])}
        leaf = (g["leftChild"] < 0).to_numpy()
        trees.append(Tree(
            left=np.array([idx.get(c, -1) if not lf else -1 for c, lf in zip(g["leftChild"], leaf)]),
            right=np.array([idx.get(c, -1) if not lf else -1 for c, lf in zip(g["rightChild"], leaf)]),
            feature=np.where(leaf, -1, g["feature"].fillna(-1).astype(int)),
            threshold=np.array([t[0] if (t is not None and len(t)) else np.nan for t in g["thr"]], dtype=float),
            value=g["prediction"].to_numpy(dtype=float),
            cover=g["rawCount"].to_numpy(dtype=float),
            weight=float(weights[tid]),
        ))
    return [t for _, t in sorted(zip(sorted(nodes.treeID.unique()), trees))]


def expected_value(tree: Tree) -> float:
    leaves = tree.left < 0
    return float(np.sum(tree.value[leaves] * tree.cover[leaves]) / tree.cover[0])


def _extend(path, pz, po, pi):
    d, z, o, w = path
    l = len(d)
    d, z, o = d + [pi], z + [pz], o + [po]
    w = [x.copy() for x in w] + [np.ones_like(po) if l == 0 else np.zeros_like(po)]
    for i in range(l - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (l + 1)
        w[i] = pz * w[i] * (l - i) / (l + 1)
    return d, z, o, w


def _unwind(path, i):
    d, z, o, w = path
    l = len(d) - 1
    n = w[l].copy()
    w = [x.copy() for x in w[:l]]
    oi, zi = o[i], z[i]
    hot = oi != 0
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(l - 1, -1, -1):
            t = w[j]
            w_hot = n * (l + 1) / ((j + 1) * np.where(hot, oi, 1.0))
            n_hot = t - w_hot * zi * (l - j) / (l + 1)
            w_cold = t * (l + 1) / (zi * (l - j)) if zi != 0 else np.zeros_like(t)
            w[j] = np.where(hot, w_hot, w_cold)
            n = np.where(hot, n_hot, n)
    return d[:i] + d[i + 1:], z[:i] + z[i + 1:], o[:i] + o[i + 1:], w


def _leaves(tree: Tree) -> list[tuple[float, dict[int, tuple[float, float | None, float | None]]]]:
    """Each leaf's value and path: per feature the share of its splits' cover that follows, and the values (above the
    first bound, up to the second) that do."""
    out = []

    def walk(j, path):
        if tree.left[j] < 0:
            out.append((tree.value[j], path))
            return
        f, t = int(tree.feature[j]), tree.threshold[j]
        share, low, high = path.get(f, (1.0, None, None))
        rest = {k: v for k, v in path.items() if k != f}
        for child, bounds in ((tree.left[j], (low, t if high is None else min(high, t))),
                              (tree.right[j], (t if low is None else max(low, t), high))):
            walk(child, rest | {f: (share * tree.cover[child] / tree.cover[j], *bounds)})

    walk(0, {})
    return out


def tree_shap(tree: Tree, X: np.ndarray) -> np.ndarray:
    """phi (rows x features) of one tree for a batch of rows (margin scale, unweighted).

    What a leaf adds depends on a row only by which of the path's features lead to it: it is worked out once for each
    such pattern (2 to the number of the path's features, or those that occur if rows are fewer) and looked up per row.
    """
    B, M = X.shape
    phi = np.zeros((M, B))
    columns = np.ascontiguousarray(X.T)
    for value, path in _leaves(tree):
        at = np.zeros(B, dtype=np.int64)
        for i, (f, (_, low, high)) in enumerate(path.items()):
            hot = np.ones(B, dtype=bool) if high is None else columns[f] <= high
            if low is not None:
                hot &= ~(columns[f] <= low)
            at |= hot.astype(np.int64) << i
        if 1 << len(path) <= B:
            patterns = np.arange(1 << len(path))
        else:
            patterns, at = np.unique(at, return_inverse=True)
        hot = (patterns[:, None] >> np.arange(len(path)) & 1).astype(float)
        steps = _extend(([], [], [], []), 1.0, np.ones(len(patterns)), -1)
        for i, (f, (share, _, _)) in enumerate(path.items()):
            steps = _extend(steps, share, hot[:, i], f)
        for i, (f, (share, _, _)) in enumerate(path.items()):
            phi[f] += (sum(_unwind(steps, i + 1)[3]) * (hot[:, i] - share) * value)[at]
    return phi.T


def ensemble_shap(trees: list[Tree], X: np.ndarray, scale: float = 2.0) -> tuple[np.ndarray, float]:
    """Log-odds attributions and base value of a boosted ensemble for a batch."""
    phi = np.zeros(X.shape)
    base = 0.0
    for t in trees:
        phi += t.weight * tree_shap(t, X)
        base += t.weight * expected_value(t)
    return scale * phi, scale * base


def ensemble_margin(trees: list[Tree], X: np.ndarray) -> np.ndarray:
    """Raw margin Σ w_t·tree_t(x) (for additivity checks)."""
    out = np.zeros(X.shape[0])
    for t in trees:
        node = np.zeros(X.shape[0], dtype=int)
        for _ in range(64):
            inner = t.left[node] >= 0
            if not inner.any():
                break
            f = np.where(inner, t.feature[node], 0)
            go_left = X[np.arange(len(node)), f] <= t.threshold[node]
            node = np.where(inner, np.where(go_left, t.left[node], t.right[node]), node)
        out += t.weight * t.value[node]
    return out


def shap_values(spark: SparkSession, rows: DataFrame, feature_cols: list[str], model_path: str,
                key: str = "subject_id", parts: int | None = None) -> DataFrame:
    """One attribution row per input row: key, shap_<feature>..., base_value (``parts``: see ``spread``)."""
    trees = load_ensemble(spark, model_path)
    n_nodes = sum(len(t.value) for t in trees)
    if n_nodes > MAX_ENSEMBLE_NODES:
        raise ValueError(f"ensemble of {n_nodes} nodes is too large to broadcast")
    bc = spark.sparkContext.broadcast(trees)
    out_cols = [f"shap_{c}" for c in feature_cols]
    schema = ", ".join([f"{key} long"] + [f"{c} double" for c in out_cols] + ["base_value double"])

    def attribute(batches):
        ens = bc.value
        for pdf in batches:
            X = pdf[feature_cols].to_numpy(dtype=float)
            phi, base = ensemble_shap(ens, X)
            out = pd.DataFrame(phi, columns=out_cols)
            out.insert(0, key, pdf[key].to_numpy())
            out["base_value"] = base
            yield out

    inp = spread(rows.select(key, *[F.col(c).cast("double") for c in feature_cols]), parts)
    return inp.mapInPandas(attribute, schema)


def waterfall(attributions: DataFrame, rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """Steps from the ensemble's expected value to a row's log-odds, largest attribution first.

    One row per feature: (key, rank, feature, feature_value, shap, base_value, start, end), with the first
    ``start`` at the base value and the last ``end`` at the log-odds. Ranked and summed inside the row.
    """
    from carepath.operators.serve import ranked_drivers
    features = [c for c in attributions.columns if c.startswith("shap_")]
    values = F.array(*[F.col(c.removeprefix("shap_")).cast("double") for c in features])
    j = attributions.join(rows, key).select(key, "base_value", ranked_drivers(attributions).alias("d"), values.alias("v"))

    def upto(i):
        return F.aggregate(F.slice("d", 1, i), F.col("base_value"), lambda acc, x: acc + x["value"])
    steps = F.transform("d", lambda x, i: F.struct(
        (i + 1).alias("rank"), x["feature"].alias("feature"), F.get("v", x["position"]).alias("feature_value"),
        x["value"].alias("shap"), upto(i).alias("start"), upto(i + 1).alias("end")))
    return j.select(key, "base_value", F.inline(steps))


def gbt_stage_path(pipeline_path: str, spark: SparkSession) -> str:
    """Folder of the boosted-tree stage inside a saved pipeline."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{pipeline_path}/stages")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p))
    gbt = [n for n in names if "GBT" in n]
    return f"{pipeline_path}/stages/{gbt[-1]}"
