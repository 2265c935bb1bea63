"""Histogram boosting against a plain implementation that sees all rows at once."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from solvens.ml.attribution import base_values, tree_attributions
from solvens.ml.histogram import HistogramBoost, HistogramBoostModel
from solvens.ml.training import features_vector

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        y = i % 3
        rows.append((f"r{i}", y, rng.gauss(y, 1.0), rng.choice([0.0, 1.0, 2.0]) + y % 2, rng.random()))
    df = spark.createDataFrame(rows, "row_id string, target int, a double, b double, c double").repartition(5)
    return features_vector(df, COLUMNS).cache()


def plain(x, y, classes, rounds, depth, rate, l2, edges, max_leaves):
    """Margins after all rounds; leaf-wise growth opens one leaf at a time."""
    bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
    margins = np.tile([math.log((y == k).mean()) for k in range(classes)], (len(y), 1))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        step = np.zeros_like(margins)
        for k in range(classes):
            g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])

            def best(rows):
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                found = None
                for f in range(x.shape[1]):
                    for cut in range(len(edges[f])):
                        left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if len(left) and len(right):
                            gain = score(left) + score(right) - score(rows)
                            if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                                found = gain, left, right
                return found

            leaves, heap, count = [], [], 0

            def offer(rows, level):
                nonlocal count
                found = best(rows) if level < depth else None
                count += 1
                if found:
                    heapq.heappush(heap, (-found[0], count, rows, found, level))
                else:
                    leaves.append(rows)

            offer(np.arange(len(y)), 0)
            splits = 0
            while heap:
                _, _, rows, found, level = heapq.heappop(heap)
                if max_leaves and splits >= max_leaves - 1:
                    leaves.append(rows)
                    continue
                splits += 1
                offer(found[1], level + 1)
                offer(found[2], level + 1)
            for rows in leaves:
                step[rows, k] = -rate * g[rows].sum() / (h[rows].sum() + l2)
        margins = margins + step
    return margins


@pytest.mark.parametrize("max_leaves, depth", [(None, 3), (5, 4)])
def test_equals_plain_boosting(vectors, max_leaves, depth):
    boost = HistogramBoost(rounds=4, max_depth=depth, learning_rate=0.3, l2=2.0, max_leaves=max_leaves, max_bins=8, classes=3, checkpoint_interval=2)
    model = boost.fit(vectors)
    got = model.margins(vectors).select("features", "target", "margin_0", "margin_1", "margin_2").collect()
    x, y = np.array([r.features.toArray() for r in got]), np.array([r.target for r in got])
    from pyspark.ml.functions import vector_to_array
    from solvens.ml.histogram import bin_edges

    edges = bin_edges(vectors.select(vector_to_array("features").alias("x")), 8)
    expected = plain(x, y, 3, 4, depth, 0.3, 2.0, edges, max_leaves)
    assert np.abs(np.array([[r.margin_0, r.margin_1, r.margin_2] for r in got]) - expected).max() < 1e-6
    if max_leaves:
        assert all(sum(v < 0 for v in t.left) <= max_leaves for own in model.trees for t in own)


def test_samples_weights_and_store(spark, vectors, tmp_path):
    boost = HistogramBoost(rounds=6, max_depth=3, subsample=0.8, colsample=0.67, classes=3, weight="w")
    model = boost.fit(vectors.selectExpr("*", "1.0 + target as w"))
    scored = model.transform(vectors)
    assert scored.where("pred = target").count() > 0.6 * 400
    model.save(spark, str(tmp_path / "m"))
    again = HistogramBoostModel.load(spark, str(tmp_path / "m"))
    assert again == model and sum(model.feature_importances()) == pytest.approx(1.0)


def test_attributions_add_up(spark, vectors):
    model = HistogramBoost(rounds=3, max_depth=3, classes=3).fit(vectors)
    base = base_values(model, spark)
    sums = tree_attributions(model, vectors.withColumn("pred", vectors["target"]), ["row_id"], COLUMNS, predicted=None).groupBy("row_id", "class_id").sum("phi")
    margins = {r.row_id: (r.margin_0, r.margin_1, r.margin_2) for r in model.margins(vectors).collect()}
    for row_id, k, phi in sums.collect():
        assert phi + base[k] == pytest.approx(margins[row_id][k], abs=1e-6)


def test_odd_input(spark, vectors):
    with pytest.raises(ValueError):
        HistogramBoost(rounds=1, classes=2).fit(vectors)
    flat = spark.createDataFrame([(0, [1.0, None]), (1, [1.0, float("nan")]), (1, [1.0, 2.0])], "target int, features array<double>")
    model = HistogramBoost(rounds=2, classes=2).fit(flat)
    assert all(sum(r.probs) == pytest.approx(1.0) for r in model.transform(flat).collect())


def test_vectors_become_a_matrix_at_once():
    """Row by row this took most of the time of scoring."""
    import time

    import pandas as pd

    from solvens.ml.histogram import _padded

    odd = _padded(pd.Series([np.array([1.0, 2.0]), np.array([3.0]), np.array([None, 4.0, 5.0], dtype=object)]), 4)
    assert np.array_equal(odd, [[1, 2, np.nan, np.nan], [3, np.nan, np.nan, np.nan], [np.nan, 4, 5, np.nan]], equal_nan=True)
    many = pd.Series(list(np.random.default_rng(1).normal(size=(20_000, 18))))
    start = time.process_time()
    assert np.array_equal(_padded(many, 18), np.stack(many.to_list()))
    assert time.process_time() - start < 0.3


def test_blocks_hold_all_rows_in_their_order(spark):
    from solvens.ml.blocks import blocks

    rows = spark.range(10_000, numPartitions=3).select(F.array(F.col("id").cast("double"), F.when(F.col("id") % 5 > 0, 1.0)).alias("x"), F.col("id").cast("int").alias("y"))
    got = blocks(rows, "x", {"y": F.col("y")}, 1_000).collect()
    assert max(len(y) for _, y in got) <= 1_000 and len(got) <= 12
    assert np.array_equal(np.concatenate([y for _, y in got]), np.arange(10_000))
    x = np.concatenate([x for x, _ in got])
    assert np.array_equal(x[:, 0], np.arange(10_000)) and np.isnan(x[:, 1]).sum() == 2_000
