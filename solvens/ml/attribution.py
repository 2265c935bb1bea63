"""Per-row feature attributions of tree ensembles, exact and path-dependent.

A row's Shapley value of feature i in a leaf with value v is
``v (met_i - share_i)`` times the integral over t in [0, 1] of the product over the other path features j of
``share_j (1 - t) + met_j t``: the weight s! (d-1-s)! / d! of a coalition of size s is a Beta integral.  The
integrand is a polynomial of degree d - 1, which ceil(d / 2) Gauss-Legendre nodes integrate exactly, so a leaf costs
about d^2 / 2 products per row.  What travels to the tasks is the list of leaf paths: it grows with the model's nodes, at any depth.
Scoring is ``mapInPandas``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.ml.boosting import SoftmaxBoostModel
from solvens.ml.histogram import HistogramBoostModel, Tree
from solvens.session import scratch_path


@dataclass
class Leaf:
    """Value (one number per output) and the path: features, intervals (low, high], cover shares."""

    value: np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def saved_nodes(model, spark) -> pd.DataFrame:
    """Nodes of a saved tree ensemble, with the weight of each tree."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    n = "nodeData"
    # Tree number, metadata, weight: the names differ between versions of Spark, the order doesn't.
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        F.col(f"{n}.id").alias("id"),
        F.col(f"{n}.prediction").alias("value"),
        F.col(f"{n}.impurityStats").alias("stats"),
        F.col(f"{n}.rawCount").cast("double").alias("cover"),
        F.col(f"{n}.leftChild").alias("left"),
        F.col(f"{n}.rightChild").alias("right"),
        F.col(f"{n}.split.featureIndex").alias("feature"),
        F.when(F.size(f"{n}.split.leftCategoriesOrThreshold") > 0, F.col(f"{n}.split.leftCategoriesOrThreshold")[0]).alias("threshold"),
    )
    return nodes.join(F.broadcast(weights), "treeID").toPandas()


def _leaf_paths(nodes: dict, value_of) -> list[Leaf]:
    """Every leaf of one tree."""
    out = []
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        node = nodes[i]
        if node["left"] < 0:
            low, high, share = (np.array([p[k] for p in path.values()], float) for k in range(3))
            out.append(Leaf(value_of(node), np.array(list(path), int), low, high, share))
            continue
        f, t = int(node["feature"]), float(node["threshold"])
        for child, left in ((int(node["left"]), True), (int(node["right"]), False)):
            low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
            share *= nodes[child]["cover"] / node["cover"] if node["cover"] else 0.5
            bounds = (low, min(high, t), share) if left else (max(low, t), high, share)
            stack.append((child, {**path, f: bounds}))
    return out


def _tree_leaves(tree: Tree) -> list[Leaf]:
    nodes = {n: {c: getattr(tree, c)[n] for c in ("left", "right", "feature", "threshold", "value", "cover")} for n in range(len(tree.left))}
    return _leaf_paths(nodes, lambda node: np.array([node["value"]]))


def _class_shares(node) -> np.ndarray:
    stats = np.array(node["stats"], float)
    return stats / stats.sum() if stats.sum() else np.full(len(stats), 1 / len(stats))


def ensemble_leaves(nodes: pd.DataFrame, votes: bool = False) -> list[Leaf]:
    """Leaves of all trees, their values times the trees' weights.

    With ``votes`` a leaf's value is its share of each class, over the number of trees: the probabilities of a forest.
    """
    out = []
    trees = nodes["treeID"].nunique()
    for _, tree in nodes.groupby("treeID"):
        by_id = {int(r["id"]): r for r in tree.to_dict("records")}
        out += _leaf_paths(by_id, (lambda n: _class_shares(n) / trees) if votes else (lambda n: np.array([n["value"] * n["weight"]])))
    return out


def expected_value(leaves: list[Leaf]) -> np.ndarray:
    """Value of the ensemble under the training covers."""
    return sum(leaf.value * np.prod(leaf.share) for leaf in leaves)


def attribute(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Attributions (rows, features, outputs); with ``expected_value`` they add up to the ensemble's outputs."""
    out = np.zeros((*x.shape, len(leaves[0].value) if leaves else 1))
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            continue
        part = x[:, leaf.features]
        met = ((part > leaf.low) & (part <= leaf.high)).astype(float)
        nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
        inner = np.zeros_like(met)
        for t, w in zip((nodes + 1) / 2, weights / 2):
            factors = leaf.share * (1 - t) + met * t
            before, after = np.ones_like(factors), np.ones_like(factors)
            np.cumprod(factors[:, :-1], axis=1, out=before[:, 1:])
            after[:, :-1] = np.cumprod(factors[:, :0:-1], axis=1)[:, ::-1]
            inner += w * before * after
        out[:, leaf.features] += ((met - leaf.share) * inner)[:, :, None] * leaf.value
    return out


def model_leaves(model, spark) -> tuple[list[list[Leaf]], list[tuple[int, int]]]:
    """Lists of leaves of any fitted Spark tree model, and for each class its list and its place in the value.

    Boosted multi-class models have one list per class, forests one list with a value per class, binary boosting
    one list with one value (its margin).
    """
    if isinstance(model, HistogramBoostModel):
        return [[leaf for tree in own for leaf in _tree_leaves(tree)] for own in model.trees], [(k, 0) for k in range(model.classes)]
    if isinstance(model, SoftmaxBoostModel):
        return [ensemble_leaves(saved_nodes(m, spark)) for m in model.ensembles], [(k, 0) for k in range(model.classes)]
    votes = "RandomForestClassification" in type(model).__name__
    leaves = ensemble_leaves(saved_nodes(model, spark), votes)
    return [leaves], [(0, k) for k in range(len(leaves[0].value))]


def attribution_items(
    model,
    df: DataFrame,
    keep: list[str],
    names: list[str],
    features: str = "features",
    predicted: str | None = "pred",
) -> DataFrame:
    """One row per input row (and class): ``keep`` columns, ``class_id`` and ``items``,
    an array of (feature, phi, actual) that the report takes as it is.

    Attributions explain margins (forests: probabilities): per row and class they sum to the margin minus
    the class's base value (``base_values``).  With ``predicted`` only the
    predicted class is explained, with None every class.
    """
    spark = df.sparkSession
    lists, places = model_leaves(model, spark)
    shared = spark.sparkContext.broadcast(lists)
    chosen = [F.col(predicted).cast("int").alias("_pred")] if predicted else []
    rows = df.select(*keep, vector_to_array(features).alias("_x"), *chosen)
    kept_types = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes)

    def run(batches):
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["_x"].to_numpy()).astype(float)
            whole = {}
            for k, (own, place) in enumerate(places):
                at = np.nonzero(batch["_pred"].to_numpy() == k)[0] if predicted else np.arange(len(batch))
                if len(at):
                    if len(shared.value) > 1:
                        phi = attribute(x[at], shared.value[own])[:, :, place]
                    else:  # one list serves all classes
                        if own not in whole:
                            whole[own] = attribute(x, shared.value[own])
                        phi = whole[own][at][:, :, place]
                    part = batch[keep].iloc[at]
                    yield part.assign(class_id=np.int32(k), _phi=list(phi), _actual=list(x[at]))

    done = rows.mapInPandas(run, f"{kept_types}, class_id int, _phi array<double>, _actual array<double>")
    labels = F.array(*[F.lit(n) for n in names])
    items = F.transform(
        labels,
        lambda n, i: F.struct(n.alias("feature"), F.get("_phi", i).alias("phi"), F.get("_actual", i).alias("actual")),
    )
    return done.select(*keep, "class_id", items.alias("items"))


def tree_attributions(model, df: DataFrame, keys: list[str], names: list[str], features: str = "features", predicted: str | None = "pred") -> DataFrame:
    """Long table (keys, class_id, feature, phi, actual) of ``attribution_items``."""
    nested = attribution_items(model, df, keys, names, features, predicted)
    return nested.select(*keys, "class_id", F.inline("items"))


def base_values(model, spark) -> list[float]:
    """Expected margin (forests: probability) per class under the trees' training covers."""
    lists, places = model_leaves(model, spark)
    start = model.start if isinstance(model, (SoftmaxBoostModel, HistogramBoostModel)) else [0.0] * len(places)
    expected = [expected_value(leaves) for leaves in lists]
    return [float(start[k] + expected[own][place]) for k, (own, place) in enumerate(places)]
