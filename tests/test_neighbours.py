"""Neighbours: cells, boxes and what odd rows must not change."""

import numpy as np
import pyarrow as pa
import pytest

from solvens.operators import neighbours
from solvens.operators.neighbours import nearest_points

SCHEMA = "cls int, vec array<double>, pid string, mult bigint"


def brute(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("block, most", [(2000, 16384), (4, 16384)])
def test_points_without_all_values_hide_no_others(spark, block, most):
    """A missing value has no distance; the other points of its cell are still found."""
    x = np.random.default_rng(1).normal(size=(300, 3)) * [1, 10, 100]
    rows = [(1, [float(v) for v in r], f"p{i:03d}", 1) for i, r in enumerate(x)]
    rows += [(1, [None, float(i), 0.0], f"n{i}", 1) for i in range(60)]
    got = {}
    for r in nearest_points(spark.createDataFrame(rows, SCHEMA), 4, block=block, max_pivots=most, vectors=False).collect():
        got.setdefault(r.pid, {})[r._rn] = r.dist
    assert sorted(got) == [f"p{i:03d}" for i in range(300)]
    for i, best in enumerate(brute(x, 4)):
        assert [got[f"p{i:03d}"][n] for n in (1, 2, 3, 4)] == pytest.approx(list(best), rel=1e-12)


def test_far_from_the_origin_distances_stay_exact(spark):
    """Products lose digits there; they only choose what is computed in full."""
    x = 1e7 + np.random.default_rng(2).integers(0, 40, size=(400, 2)).astype(float)
    x = np.unique(x, axis=0)
    rows = [(0, [float(v) for v in r], f"p{i:03d}", 1) for i, r in enumerate(x)]
    got = {(r.pid, r._rn): (r.dist, r.other) for r in nearest_points(spark.createDataFrame(rows, SCHEMA), 3, block=4).collect()}
    for i, r in enumerate(x):
        d = np.sqrt(np.square(x - r).sum(axis=1))
        best = sorted((v, f"p{j:03d}") for j, v in enumerate(d) if j != i)[:3]
        assert [got[f"p{i:03d}", n] for n in (1, 2, 3)] == best


def test_few_points_are_compared_in_few_dimensions(monkeypatch):
    """Blocks whose boxes are too far are not looked at."""
    x = np.random.default_rng(3).normal(size=(20_000, 5))
    seen = []
    inner = neighbours.exact_distances
    monkeypatch.setattr(neighbours, "exact_distances", lambda a, b: (seen.append(len(a)), inner(a, b))[1])
    ids = np.arange(len(x))
    row, at, dist = neighbours.Cell(x, ids, ids, 125).nearest(x[:500], ids[:500], np.full(500, np.inf), 5)
    assert len(row) == 2_500 and sum(seen) < 50 * 500
    d = np.sqrt(np.square(x[:500, None] - x[None]).sum(-1))
    d[ids[:500], ids[:500]] = np.inf
    assert dist.reshape(500, 5) == pytest.approx(np.sort(d, axis=1)[:, :5])


def test_visits_are_handed_on_in_bounded_batches():
    """In many dimensions a point visits almost every cell; a batch of all its visits would not fit."""
    rng = np.random.default_rng(4)
    x, cells = rng.normal(size=(500, 8)), 300
    rows, ids = zip(*neighbours._crossings(x, np.zeros(500, np.int32), np.full(500, np.inf), np.arange(cells), np.full((cells, 8), -1.0), np.full((cells, 8), 1.0)))
    assert sum(map(len, rows)) == 500 * (cells - 1)
    asked = pa.RecordBatch.from_pydict({"cls": pa.array([0] * 500, pa.int32()), "cell": pa.array([0] * 500, pa.int32()), "pid": [f"p{i}" for i in range(500)], "vec": x.tolist(), "bound": [float("inf")] * 500})

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [*run(iter([asked]))]

    boxes = {0: (np.arange(cells), np.full((cells, 8), -1.0), np.full((cells, 8), 1.0))}
    made = neighbours._visits(Rows(), boxes, {(0, c): 1 for c in range(cells)})
    assert sum(b.num_rows for b in made) == 500 * (cells - 1)
    assert max(b.num_rows for b in made) <= neighbours.VISITORS
