"""Multi-class gradient boosting on histograms.

Features are binned once, into small integers by quantiles over all rows.  The binned rows stay where they are, as numpy blocks of a
partitioned, persisted RDD; the state that changes is their margins.  A level of all classes' trees takes one job: every partition drops its rows down the
trees grown so far and sums gradient, curvature and row count per (class, node, feature, bin); partitions' sums are added on the way to the driver, whose
table has ``classes x nodes x features x bins`` cells, whatever the number of rows.  Splits maximise the second-order gain with an L2 term.

Trees grow level by level, or leaf-wise when ``max_leaves`` is set: always the leaf of largest gain next.  A pass then
opens the nodes that a heap of the known gains would split within the leaves allowed; gains that come to light later can only push others out, so
the tree is the one that opening a single leaf at a time gives.

Margins are written to the shared folder every ``checkpoint_interval`` rounds.  Rows are sampled by a hash of their place in the written table, columns by the
seed, so a repeated task sees the same sample.  Null and not-a-number features count as smallest values; labels outside the classes raise an error.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax
from solvens.ml.blocks import BLOCK, blocks
from solvens.ml.boosting import softmax
from solvens.session import checkpoint_dir, materialise

#: Partitions whose sums the driver adds itself.
FLAT = 64


@dataclass
class Tree:
    """Arrays over nodes; a node without a child on the left is a leaf.  Rows with bin <= ``cut`` (value <= ``threshold``) go left."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    threshold: list = field(default_factory=lambda: [0.0])
    left: list = field(default_factory=lambda: [-1])
    right: list = field(default_factory=lambda: [-1])
    value: list = field(default_factory=lambda: [0.0])
    cover: list = field(default_factory=lambda: [0.0])
    gain: list = field(default_factory=lambda: [0.0])

    def leaf_of(self, x: np.ndarray, limits: list) -> np.ndarray:
        """The leaf of each row of ``x``, compared with ``limits`` (``cut`` or ``threshold``)."""
        feature, limit, left, right = (np.asarray(v) for v in (self.feature, limits, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while True:
            rows = np.flatnonzero(left[at] >= 0)
            if not len(rows):
                return at
            node = at[rows]
            goes_left = x[rows, feature[node]] <= limit[node]
            at[rows] = np.where(goes_left, left[node], right[node])

    def add(self) -> int:
        for values, start in ((self.feature, -1), (self.cut, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0)):
            values.append(start)
        return len(self.left) - 1


@dataclass
class Split:
    """``sides``: sums of gradient, curvature and rows of both children."""

    gain: float
    feature: int
    cut: int
    sides: tuple


def best_split(sums: np.ndarray, allowed: np.ndarray, l2: float, min_rows: int, min_gain: float) -> Split | None:
    """The split of largest gain of one node from its (features, bins, 3) sums; ties go to the first feature and bin."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    whole = sums[0].sum(axis=0)
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-12)
    gain = score(left) + score(right) - score(whole)
    gain = np.where(allowed[:, None] & (left[..., 2] >= min_rows) & (right[..., 2] >= min_rows), gain, -np.inf)
    if not gain.size or gain.max() <= min_gain:
        return None
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    return Split(float(gain[feature, cut]), int(feature), int(cut), (left[feature, cut], right[feature, cut]))


def leaf_wise(splits: dict[int, Split | None], children: dict[int, tuple[int, int]], leaves: int) -> list[int]:
    """The nodes that are split when always the open leaf of largest gain is next; nodes without known gain stay leaves."""
    heap, chosen = [], []

    def offer(node: int):
        if splits.get(node):
            heapq.heappush(heap, (-splits[node].gain, node))

    offer(0)
    while heap and len(chosen) < leaves - 1:
        node = heapq.heappop(heap)[1]
        chosen.append(node)
        for child in children.get(node, ()):
            offer(child)
    return chosen


def _softmax(margins: np.ndarray) -> np.ndarray:
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _sampled(rows: np.ndarray, share: float, seed: int) -> np.ndarray:
    h = (rows.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(np.float64) / 2**53 < share


@dataclass
class HistogramBoost:
    """Estimator; ``fit`` returns a ``HistogramBoostModel``."""

    rounds: int = 100
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    l2: float = 1.0
    max_leaves: int | None = None
    max_bins: int = 64
    min_rows: int = 1
    min_gain: float = 1e-9
    classes: int = 4
    checkpoint_interval: int = 25
    seed: int = 42
    features: str = "features"
    label: str = "target"
    weight: str | None = None

    def with_params(self, **params) -> "HistogramBoost":
        return HistogramBoost(**{**asdict(self), **params})

    def fit(self, df: DataFrame) -> "HistogramBoostModel":
        spark = df.sparkSession
        checkpoint_dir(spark)
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        x = vector_to_array(self.features) if df.schema[self.features].dataType.typeName() == "vectorudt" else F.col(self.features)
        rows = df.select(x.cast("array<double>").alias("x"), F.col(self.label).cast("int").alias("y"), weight.cast("double").alias("w"), F.monotonically_increasing_id().alias("row"))
        rows = materialise(rows, "boost")
        start = self._priors(rows)
        edges = bin_edges(rows, self.max_bins)
        packed = blocks(rows, "x", {"y": F.col("y"), "w": F.col("w"), "row": F.col("row")}, BLOCK)
        state, cores = packed.map(_binned(edges, start)), spark.sparkContext.defaultParallelism
        if state.getNumPartitions() < cores:
            state = state.repartition(cores)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[list[Tree]] = [[] for _ in range(self.classes)]
        held = None
        for r in range(self.rounds):
            grown = self._grow(state, edges, r)
            for k, tree in enumerate(grown):
                trees[k].append(tree)
            if r + 1 < self.rounds:
                before, state = state, state.map(_advance(grown)).persist(StorageLevel.MEMORY_AND_DISK)
                if (r + 1) % self.checkpoint_interval == 0:
                    state.checkpoint()
                    state.count()
                if held is not None:
                    held.unpersist()
                held = before
        state.unpersist()
        if held is not None:
            held.unpersist()
        return HistogramBoostModel(start, trees, self.features, asdict(self))

    def _priors(self, rows: DataFrame) -> list[float]:
        sums = {r.y: r.w for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        unknown = set(sums) - set(range(self.classes))
        if unknown:
            raise ValueError(f"labels outside 0..{self.classes - 1}: {sorted(unknown, key=str)}")
        whole = sum(sums.values())
        return [math.log(max(sums.get(k, 0.0), 1e-9) / whole) for k in range(self.classes)]

    def _grow(self, state, edges: list[np.ndarray], r: int) -> list[Tree]:
        """One tree per class; a job per level."""
        columns = len(edges)
        rng = np.random.default_rng([self.seed, r])
        allowed = np.ones((self.classes, columns), bool)
        if self.colsample < 1:
            n = max(1, round(self.colsample * columns))
            for k in range(self.classes):
                allowed[k] = False
                allowed[k, rng.permutation(columns)[:n]] = True
        trees = [Tree() for _ in range(self.classes)]
        splits: list[dict[int, Split | None]] = [{} for _ in trees]
        children: list[dict[int, tuple[int, int]]] = [{} for _ in trees]
        opened = [[0] for _ in trees]
        for depth in range(self.max_depth):
            sums = _histograms(state, trees, opened, columns, self.max_bins, self.subsample, self.seed * 1_000_003 + r)
            for k, tree in enumerate(trees):
                if not depth:
                    self._leaf(tree, 0, sums[k][0][0].sum(axis=0))
                for i, node in enumerate(opened[k]):
                    splits[k][node] = best_split(sums[k][i], allowed[k], self.l2, self.min_rows, self.min_gain)
                opened[k] = []
                chosen = leaf_wise(splits[k], children[k], self.max_leaves) if self.max_leaves else [n for n in splits[k] if splits[k][n]]
                for node in chosen:
                    if node not in children[k]:
                        split = splits[k][node]
                        tree.feature[node], tree.cut[node], tree.threshold[node], tree.gain[node] = split.feature, split.cut, float(edges[split.feature][split.cut]), split.gain
                        children[k][node] = tree.left[node], tree.right[node] = tree.add(), tree.add()
                        for child, side in zip(children[k][node], split.sides, strict=True):
                            self._leaf(tree, child, side)
                        opened[k] += children[k][node]
            if not any(opened):
                break
        if self.max_leaves:  # what later gains pushed out becomes a leaf again
            trees = [_pruned(t, set(leaf_wise(s, c, self.max_leaves))) for t, s, c in zip(trees, splits, children, strict=True)]
        return trees


    def _leaf(self, tree: Tree, node: int, sums: np.ndarray) -> None:
        """A Newton step as the value of a node."""
        g, h, n = (float(v) for v in sums)
        tree.value[node], tree.cover[node] = self.learning_rate * -g / max(h + self.l2, 1e-12), n


def _pruned(tree: Tree, chosen: set[int]) -> Tree:
    out = Tree()
    stack = [(0, 0)]
    while stack:
        old, new = stack.pop()
        out.value[new], out.cover[new] = tree.value[old], tree.cover[old]
        if old in chosen:
            out.feature[new], out.cut[new], out.threshold[new], out.gain[new] = tree.feature[old], tree.cut[old], tree.threshold[old], tree.gain[old]
            out.left[new], out.right[new] = out.add(), out.add()
            stack += [(tree.left[old], out.left[new]), (tree.right[old], out.right[new])]
    return out


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Upper limits of all bins but the last, per feature: quantiles over all rows."""
    columns = rows.agg(F.max(F.size("x"))).first()[0] or 0
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    finite = lambda c: F.when(F.isnan(c), None).otherwise(c)
    found = rows.agg(*[F.percentile_approx(finite(F.get("x", F.lit(i))), shares, 100 * bins).alias(f"q{i}") for i in range(columns)]).first()
    return [np.unique(np.array([v for v in found[i] or [0.0] if v is not None], float)) for i in range(columns)]


def _binned(edges: list[np.ndarray], start: list[float]):
    """A block of rows as (bins, labels, weights, margins, row numbers)."""

    def run(block):
        x, y, w, number = block
        x = np.where(np.isnan(x), -np.inf, x)
        bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8 if max(map(len, edges), default=0) < 256 else np.int32)
        return bins, y, w, np.tile(start, (len(y), 1)), number

    return run


def _advance(trees: list[Tree]):
    """The margins after one more round."""

    def run(block):
        bins, y, w, margins, number = block
        steps = [np.asarray(t.value)[t.leaf_of(bins, t.cut)] for t in trees]
        return bins, y, w, margins + np.stack(steps, axis=1), number

    return run


def _histograms(state, trees: list[Tree], opened: list[list[int]], columns: int, bins: int, share: float, seed: int) -> list[np.ndarray]:
    """Per class (open nodes, columns, bins, 3): sums of gradient, curvature and rows."""

    def run(blocks):
        out = [np.zeros((len(o), columns, bins, 3)) for o in opened]
        for x, y, w, margins, number in blocks:
            if share < 1:
                kept = _sampled(number, share, seed)
                x, y, w, margins = x[kept], y[kept], w[kept], margins[kept]
            p = _softmax(margins)
            for k, (tree, nodes) in enumerate(zip(trees, opened, strict=True)):
                if not nodes:
                    continue
                place = np.full(len(tree.left), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[tree.leaf_of(x, tree.cut)]
                rows = np.flatnonzero(at >= 0)
                g, h = w[rows] * (p[rows, k] - (y[rows] == k)), w[rows] * p[rows, k] * (1 - p[rows, k])
                for f in range(columns):
                    cell = at[rows] * bins + x[rows, f]
                    for j, amount in enumerate((g, h, None)):
                        out[k][:, f, :, j] += np.bincount(cell, amount, len(nodes) * bins).reshape(len(nodes), bins)
        yield out

    parts = state.mapPartitions(run)
    add = lambda a, b: [x + y for x, y in zip(a, b, strict=True)]
    return parts.treeReduce(add, 1 if state.getNumPartitions() <= FLAT else 2)


def _padded(x: pd.Series, width: int) -> np.ndarray:
    """Vectors as a matrix of at least ``width`` columns; what is missing is not-a-number."""
    lengths = np.fromiter(map(len, x), np.int64, len(x))
    columns = max(width, int(lengths.max(initial=0)))
    out = np.full((len(x), columns), math.nan)
    if len(x):
        out[np.arange(columns)[None, :] < lengths[:, None]] = np.concatenate(x.to_list()).astype(float)
    return out


@dataclass
class HistogramBoostModel:
    start: list[float]
    trees: list[list[Tree]]
    features: str = "features"
    params: dict = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.start)

    def first_rounds(self, rounds: int) -> "HistogramBoostModel":
        """The model that a run of only ``rounds`` rounds gives: later rounds change nothing in earlier trees."""
        return HistogramBoostModel(self.start, [own[:rounds] for own in self.trees], self.features, {**self.params, "rounds": rounds})

    def margin_arrays(self, x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), -np.inf, x)
        out = np.tile(self.start, (len(x), 1))
        for k, trees in enumerate(self.trees):
            for tree in trees:
                out[:, k] += np.asarray(tree.value)[tree.leaf_of(x, tree.threshold)]
        return out

    def margins(self, df: DataFrame) -> DataFrame:
        """Adds one column ``margin_<k>`` per class."""
        model = self
        width = max((max(t.feature) for own in self.trees for t in own), default=-1) + 1

        @F.pandas_udf("array<double>")
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.margin_arrays(_padded(x, width))))

        is_vector = df.schema[self.features].dataType.typeName() == "vectorudt"
        out = df.withColumn("_margins", margin(vector_to_array(self.features) if is_vector else F.col(self.features)))
        return out.withColumns({f"margin_{k}": F.get("_margins", F.lit(k)) for k in range(self.classes)}).drop("_margins")

    def transform(self, df: DataFrame, probs: str = "probs", pred: str = "pred") -> DataFrame:
        names = [f"margin_{k}" for k in range(self.classes)]
        out = self.margins(df).withColumn(probs, F.array(*softmax([F.col(n) for n in names])))
        return out.drop(*names).withColumn(pred, argmax(probs))

    def feature_importances(self, columns: int | None = None) -> list[float]:
        """Split gains per feature, summing to 1."""
        columns = columns or max((max(t.feature) for own in self.trees for t in own), default=-1) + 1
        gains = np.zeros(columns)
        for own in self.trees:
            for t in own:
                for feature, gain in zip(t.feature, t.gain, strict=True):
                    if feature >= 0:
                        gains[feature] += gain
        return [float(v) for v in (gains / gains.sum() if gains.sum() else gains)]

    def node_rows(self) -> list[tuple]:
        """(class, tree, node, feature, cut, threshold, left, right, value, cover, gain) of all nodes."""
        return [(k, i, n, *(getattr(t, c)[n] for c in NODE)) for k, own in enumerate(self.trees) for i, t in enumerate(own) for n in range(len(t.left))]

    def save(self, spark, path: str) -> None:
        schema = "class int, tree int, node int, feature int, cut int, threshold double, left int, right int, value double, cover double, gain double"
        spark.createDataFrame(self.node_rows(), schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = json.dumps({"start": self.start, "features": self.features, "params": self.params})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "HistogramBoostModel":
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)
        trees: list[list[Tree]] = [[] for _ in meta["start"]]
        for row in spark.read.parquet(f"{path}/nodes").orderBy("class", "tree", "node").collect():
            if row["node"] == 0:
                trees[row["class"]].append(Tree(**{c: [] for c in NODE}))
            for c in NODE:
                getattr(trees[row["class"]][-1], c).append(row[c])
        return HistogramBoostModel(meta["start"], trees, meta["features"], meta["params"])


NODE = ("feature", "cut", "threshold", "left", "right", "value", "cover", "gain")
