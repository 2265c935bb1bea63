"""The Newton regression against Spark's own, and grids that share what they can."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from solvens.ml import models, regression, training
from solvens.ml.stages import Preprocess
from solvens.operators.preprocessing import features_vector


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    made = []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 2)
        y = max(range(3), key=lambda k: [a, -a + b, 0.4 * b][k] + rng.gauss(0, 1.5))
        made.append((f"r{i}", y, i % 3, a, b, a - b, 7.0, 1.0 + (i % 4)))  # dependent and constant features
    table = spark.createDataFrame(made, "row_id string, target int, fold int, a double, b double, c double, d double, w double")
    return features_vector(table, ["a", "b", "c", "d"]).cache()


def spark_fit(rows, **params):
    lr = LogisticRegression(featuresCol="features", labelCol="target", family="multinomial", standardization=False, maxIter=3000, tol=1e-13, **params)
    return lr.fit(rows)


@pytest.mark.parametrize("weight", [None, "w"])
def test_the_lowest_point_is_found_in_few_jobs(rows, weight, monkeypatch):
    passes = []
    inner = regression._sums
    monkeypatch.setattr(regression, "_sums", lambda *a: (passes.append(1), inner(*a))[1])
    found = models.logistic_regression(900, C=10.0, label="target", weight=weight).fit(rows)
    assert isinstance(found, LogisticRegressionModel) and len(passes) < 40
    best = spark_fit(rows, regParam=1 / 9000, **({"weightCol": weight} if weight else {}))
    assert found.coefficientMatrix.toArray() == pytest.approx(best.coefficientMatrix.toArray(), abs=2e-4)
    assert found.interceptVector.toArray() == pytest.approx(best.interceptVector.toArray(), abs=2e-4)


def test_odd_labels(spark, rows):
    one = models.logistic_regression(10, label="target").fit(rows.withColumn("target", F.lit(1)))
    assert one.transform(rows).filter("pred <> 1").count() == 0
    gap = models.logistic_regression(900, label="target").fit(rows.withColumn("target", F.when(F.col("target") == 1, 3).otherwise(F.col("target"))))
    assert gap.numClasses == 4 and gap.transform(rows).filter("pred = 1").count() == 0


def test_grid_points_share_their_preprocessing(rows, monkeypatch):
    fits = []
    inner = Preprocess._fit
    monkeypatch.setattr(Preprocess, "_fit", lambda self, df: (fits.append(1), inner(self, df))[1])
    lr = models.logistic_regression(1)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1e-4, 1e-2, 1.0, 100.0]).build()
    plain = rows.drop("features")
    found = training.spark_grid_search(Pipeline(stages=[Preprocess(columns=["a", "b", "c"], scaled=True), lr]), grid, plain, folds=3)
    assert len(fits) == 3 + 1  # once a fold, once for the best
    for reg, metric in zip([1e-4, 100.0], [found.avgMetrics[0], found.avgMetrics[3]]):
        each = []
        for f in range(3):
            fitted = Pipeline(stages=[Preprocess(columns=["a", "b", "c"], scaled=True), lr]).fit(plain.filter(F.col("fold") != f), {lr.regParam: reg})
            each.append(training.MacroF1Evaluator().evaluate(fitted.transform(plain.filter(F.col("fold") == f))))
        assert metric == pytest.approx(np.mean(each))


def test_folds_are_prepared_side_by_side(rows, monkeypatch):
    """Each fold waits for another one: one after the other they would never end."""
    import threading

    met = threading.Barrier(3, timeout=60)
    inner = training.Prepared.fit
    monkeypatch.setattr(training.Prepared, "fit", staticmethod(lambda *a, **kw: (met.wait(), inner(*a, **kw))[1]))
    folds = training.prepare_folds("logistic_regression", rows.drop("features"), ["a", "b", "c"])
    assert [f.fold for f in folds] == [0, 1, 2] and sum(f.valid.count() for f in folds) == 900
