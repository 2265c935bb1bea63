"""Multinomial regression with an L2 penalty by Newton's method.

The loss is Spark's: the weighted mean of the negative log-likelihood and half the squared coefficients times ``regParam``, intercepts left out.  Spark's own
fit takes a job for every gradient step, hundreds to thousands when features depend on each other; a Newton step takes one job too, but uses the
curvature, a square of (classes x features) numbers whatever the rows, and ends after some tens.  Rows stay where they are, as numpy blocks.
"""

from __future__ import annotations

from threading import Lock

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.ml.blocks import blocks
from solvens.session import materialise

#: Partitions whose sums the driver adds itself.
FLAT = 64
#: A step is the last when it can lower the loss by this share at most.
ENOUGH = 1e-12
#: Times a step is halved before the point reached counts as the lowest.
HALVINGS = 30


def _added(rdd, run, add):
    return rdd.mapPartitions(run).treeReduce(add, 1 if rdd.getNumPartitions() <= FLAT else 2)


def _extent(rdd) -> tuple:
    """Rows of each class by weight, least and largest value of every feature."""

    def run(parts):
        for x, y, w in parts:
            if np.any(y < 0) or np.any(y != np.floor(y)):
                raise ValueError("labels must be whole numbers from 0 on")
            yield np.bincount(y.astype(np.int64), w), x.min(axis=0), x.max(axis=0), float(np.isnan(x).any())

    def add(a, b):
        sums = np.zeros(max(len(a[0]), len(b[0])))
        for s in (a[0], b[0]):
            sums[: len(s)] += s
        return sums, np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), max(a[3], b[3])

    return _added(rdd, run, add)


def _sums(rdd, beta: np.ndarray, used: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature over all rows; ``beta`` is (classes, used features and the intercept)."""
    classes, width = beta.shape

    def run(parts):
        loss, slope, curve = 0.0, np.zeros((classes, width)), np.zeros((classes, classes, width, width))
        for x, y, w in parts:
            x = np.column_stack([x[:, used], np.ones(len(x))])
            margin = x @ beta.T
            margin -= margin.max(axis=1, keepdims=True)
            powers = np.exp(margin)
            whole = powers.sum(axis=1)
            p, rows, own = powers / whole[:, None], np.arange(len(x)), y.astype(np.int64)
            loss += float(w @ (np.log(whole) - margin[rows, own]))
            for k in range(classes):
                for m in range(k, classes):
                    curve[k, m] += x.T @ (x * (w * p[:, k] * ((k == m) - p[:, m]))[:, None])
            p[rows, own] -= 1
            slope += (p * w[:, None]).T @ x
        yield loss, slope, curve

    loss, slope, curve = _added(rdd, run, lambda a, b: tuple(u + v for u, v in zip(a, b, strict=True)))
    for k in range(classes):
        for m in range(k):
            curve[k, m] = curve[m, k].T
    return loss, slope, curve.transpose(0, 2, 1, 3).reshape(classes * width, classes * width)


def newton(rdd, sums: np.ndarray, used: np.ndarray, penalty: float, most: int) -> np.ndarray:
    """The lowest point of the penalised loss, from the frequencies of the classes on; a job per step."""
    classes, width, whole = len(sums), int(used.sum()) + 1, sums.sum()
    start = np.log(np.maximum(sums, 1e-9) / whole)
    at = np.zeros((classes, width))
    at[:, -1] = start - start.mean()
    ridge = np.full((classes, width), penalty)
    ridge[:, -1] = 0
    # Adding a number to all intercepts changes nothing; this keeps the system solvable and their mean where it is.
    fixed = np.zeros((classes, width, classes, width))
    fixed[:, -1, :, -1] = 1 / classes
    if not penalty:  # the same holds of every feature's coefficients then
        for f in range(width):
            fixed[:, f, :, f] = 1 / classes
    fixed = fixed.reshape(classes * width, -1)

    def judged(beta):
        loss, slope, curve = _sums(rdd, beta, used)
        return loss / whole + 0.5 * float((ridge * beta**2).sum()), slope / whole + ridge * beta, curve / whole + np.diag(ridge.ravel()) + fixed

    loss, slope, curve = judged(at)
    for _ in range(most):
        step = -np.linalg.lstsq(curve, slope.ravel(), rcond=1e-15)[0].reshape(at.shape)
        gain = -float((slope * step).sum()) / 2
        if gain <= ENOUGH * max(abs(loss), 1e-6):
            break
        for halved in range(HALVINGS):
            to = at + step / 2**halved
            after = judged(to)
            if after[0] <= loss - 1e-4 * gain / 2**halved:
                break
        else:
            break
        at, (loss, slope, curve) = to, after
    at[:, -1] -= at[:, -1].mean()
    return at


class NewtonRegression(LogisticRegression):
    """Spark's multinomial regression with its parameters and its model, fitted by ``newton``; features are used as they are."""

    def _blocks(self, df: DataFrame):
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") and self.getWeightCol() else F.lit(1.0)
        columns = {"y": F.col(self.getLabelCol()).cast("double"), "w": weight.cast("double")}
        return blocks(df, self.getFeaturesCol(), columns).persist(StorageLevel.MEMORY_AND_DISK)

    def _fit_java(self, dataset: DataFrame):
        held = self._blocks(dataset)
        try:
            return self._model_of(held, _extent(held), dataset)
        finally:
            held.unpersist()

    def _model_of(self, held, extent: tuple, dataset: DataFrame):
        sums, low, high, missing = extent
        if missing:
            raise ValueError("features hold values that are missing or not a number")
        if np.count_nonzero(sums) < 2 or self.getElasticNetParam() or not self.getFitIntercept() or self.getStandardization():
            return super()._fit_java(dataset)  # nothing to fit, or another loss
        used = high > low  # a constant feature gets no coefficient
        found = newton(held, sums, used, self.getRegParam(), self.getMaxIter())
        coefficients = np.zeros((len(sums), len(used)))
        coefficients[:, used] = found[:, :-1]
        sc = dataset.sparkSession.sparkContext
        matrix = DenseMatrix(*coefficients.shape, coefficients.ravel(), True)
        model = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel
        return model(self.uid, _py2java(sc, matrix), _py2java(sc, DenseVector(found[:, -1])), len(sums), True)

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """Points of a grid share the blocks."""
        own = self.copy()

        def prepare():
            held = own._blocks(dataset)
            return held, _extent(held)

        def fit(shared, point):
            estimator = own.copy(point)
            return estimator._copyValues(estimator._create_model(estimator._model_of(*shared, dataset)))

        return _Shared(prepare, fit, lambda shared: shared[0].unpersist(), paramMaps)


class SharedPipeline(Pipeline):
    """A pipeline whose leading stages are fitted once for all points of a grid that don't touch them."""

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        stages = self.getStages()
        touched = {p.parent for point in paramMaps for p in point}
        if len(stages) < 2 or touched & {self.uid, *[s.uid for s in stages[:-1]]}:
            return super().fitMultiple(dataset, paramMaps)
        leading, last = Pipeline(stages=stages[:-1]), stages[-1]

        def prepare():
            fitted = leading.fit(dataset)
            names = [last.getOrDefault(p) for p in ("featuresCol", "labelCol", "weightCol") if last.hasParam(p) and last.isDefined(p)]
            rows = materialise(fitted.transform(dataset).select(*dict.fromkeys(n for n in names if n)), "shared")
            models = last.fitMultiple(rows, paramMaps)
            return fitted, models

        def fit(shared, _):
            i, model = next(shared[1])
            return i, PipelineModel([*shared[0].stages, model])

        return _Shared(prepare, fit, lambda _: None, paramMaps, numbered=True)


class _Shared:
    """Iterator of (place, model) for several threads: ``prepare`` runs once, ``fit`` once per point, ``end`` after the last."""

    def __init__(self, prepare, fit, end, points, numbered: bool = False):
        self.prepare, self.fit, self.end, self.points, self.numbered = prepare, fit, end, list(points), numbered
        self.lock, self.shared, self.begun, self.over = Lock(), None, 0, 0

    def __iter__(self):
        return self

    def __next__(self):
        with self.lock:
            i = self.begun
            if i >= len(self.points):
                raise StopIteration
            if self.shared is None:
                self.shared = self.prepare()
            self.begun += 1
        try:
            found = self.fit(self.shared, self.points[i])
        finally:
            with self.lock:
                self.over += 1
                if self.over == len(self.points):
                    self.end(self.shared)
        return found if self.numbered else (i, found)
