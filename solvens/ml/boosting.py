"""Multi-class gradient boosting on Spark's regression trees.

Spark's own boosted classifier is binary.  Here every round fits one regression
tree per class to the working response of the softmax loss, with the curvature
as row weight, so a leaf's weighted mean is a Newton step (Friedman, Hastie and
Tibshirani 2000).  All passes over rows are Spark ML tree fits.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax
from solvens.functions.numeric import total
from solvens.session import materialise


def softmax(margins: list[Column]) -> list[Column]:
    top = F.greatest(*margins) if len(margins) > 1 else margins[0]
    powers = [F.exp(m - top) for m in margins]
    whole = total(powers)
    return [p / whole for p in powers]


@dataclass
class SoftmaxBoost:
    """Estimator; ``fit`` returns a ``SoftmaxBoostModel``.

    Margins are carried from round to round in a persisted table.  Every
    ``checkpoint_interval`` rounds they are written to the shared folder, which
    bounds what the loss of an executor can make Spark compute again.

    ``response_limit`` clips the working response, which keeps single rows whose probability is almost 0 or 1 from
    deciding a split; None leaves every leaf the plain Newton step.  ``min_curvature`` is the least row weight.
    """

    rounds: int = 20
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 1.0
    colsample: float = 1.0
    max_bins: int = 32
    min_rows: int = 1
    classes: int = 4
    checkpoint_interval: int = 5
    parallelism: int = 4
    seed: int = 42
    features: str = "features"
    label: str = "target"
    weight: str | None = None
    response_limit: float | None = 4.0
    min_curvature: float = 1e-6

    def with_params(self, **params) -> "SoftmaxBoost":
        return SoftmaxBoost(**{**asdict(self), **params})

    def fit(self, df: DataFrame) -> "SoftmaxBoostModel":
        weight = F.col(self.weight) if self.weight else F.lit(1.0)
        rows = df.select(F.col(self.features).alias("x"), F.col(self.label).cast("int").alias("y"), weight.alias("w"))
        start = self._priors(rows)
        margins = [f"m{k}" for k in range(self.classes)]
        state = rows.select("*", *[F.lit(start[k]).alias(m) for k, m in enumerate(margins)])
        state = materialise(state, "boost")
        trees: list[list] = [[] for _ in range(self.classes)]
        held = None
        with ThreadPoolExecutor(self.parallelism) as pool:
            for r in range(self.rounds):
                fitted = list(pool.map(lambda k, s=state, r=r: self._fit_tree(s, margins, k, r), range(self.classes)))
                if r + 1 == self.rounds:
                    for k, model in enumerate(fitted):
                        trees[k].append(model)
                    break
                after = state
                for k, model in enumerate(fitted):
                    trees[k].append(model)
                    after = model.setPredictionCol("_step").transform(after)
                    after = after.withColumn(f"m{k}", F.col(f"m{k}") + self.learning_rate * F.col("_step")).drop("_step")
                if (r + 1) % self.checkpoint_interval == 0:
                    state, fresh = materialise(after, "boost"), None
                else:
                    state = fresh = after.persist(StorageLevel.MEMORY_AND_DISK)
                if held is not None:
                    state.count()
                    held.unpersist()
                held = fresh
        if held is not None:
            held.unpersist()
        return SoftmaxBoostModel(
            start, [_ensemble(df, t, self.learning_rate) for t in trees], self.features, asdict(self)
        )

    def _priors(self, rows: DataFrame) -> list[float]:
        sums = {r.y: r.w for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        unknown = set(sums) - set(range(self.classes))
        if unknown:
            raise ValueError(f"labels outside 0..{self.classes - 1}: {sorted(unknown, key=str)}")
        whole = sum(sums.values())
        return [math.log(max(sums.get(k, 0.0), 1e-9) / whole) for k in range(self.classes)]

    def _fit_tree(self, state: DataFrame, margins: list[str], k: int, r: int):
        p = softmax([F.col(m) for m in margins])[k]
        rows = state.select("x", "y", "w", p.alias("p"))
        curve = F.greatest(F.col("p") * (1 - F.col("p")), F.lit(self.min_curvature))
        response = ((F.col("y") == k).cast("double") - F.col("p")) / curve
        if self.response_limit is not None:
            response = F.greatest(F.lit(-self.response_limit), F.least(F.lit(self.response_limit), response))
        rows = rows.select("x", response.alias("z"), (curve * F.col("w")).alias("h"))
        forest = RandomForestRegressor(
            featuresCol="x",
            labelCol="z",
            weightCol="h",
            numTrees=1,
            bootstrap=False,
            maxDepth=self.max_depth,
            maxBins=self.max_bins,
            minInstancesPerNode=self.min_rows,
            subsamplingRate=self.subsample,
            featureSubsetStrategy="all" if self.colsample >= 1 else str(self.colsample),
            seed=self.seed + 1000 * r + k,
        )
        return forest.fit(rows).trees[0].setFeaturesCol("x")


def _ensemble(df: DataFrame, trees: list, learning_rate: float) -> GBTRegressionModel:
    """One persisted-able Spark model from the trees of a class."""
    sc = df.sparkSession.sparkContext
    gateway, jvm = sc._gateway, sc._jvm
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(kind, len(trees))
    weights = gateway.new_array(jvm.double, len(trees))
    for i, t in enumerate(trees):
        array[i], weights[i] = t._java_obj, float(learning_rate)
    uid = f"boost_{trees[0].uid}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, array, weights))


@dataclass
class SoftmaxBoostModel:
    start: list[float]
    ensembles: list[GBTRegressionModel]
    features: str = "features"
    params: dict = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.start)

    def margins(self, df: DataFrame) -> DataFrame:
        """Adds one column ``margin_<k>`` per class."""
        out = df
        for k, model in enumerate(self.ensembles):
            out = model.setFeaturesCol(self.features).setPredictionCol("_step").transform(out)
            out = out.withColumn(f"margin_{k}", F.lit(self.start[k]) + F.col("_step")).drop("_step")
        return out

    def transform(self, df: DataFrame, probs: str = "probs", pred: str = "pred") -> DataFrame:
        names = [f"margin_{k}" for k in range(self.classes)]
        out = self.margins(df).withColumn(probs, F.array(*softmax([F.col(n) for n in names])))
        return out.drop(*names).withColumn(pred, argmax(probs))

    def feature_importances(self) -> list[float]:
        """Mean of the classes' split gains, summing to 1."""
        parts = [m.featureImportances.toArray() for m in self.ensembles]
        mean = sum(parts) / len(parts)
        return [float(v) for v in (mean / mean.sum() if mean.sum() else mean)]

    def save(self, spark, path: str) -> None:
        for k, m in enumerate(self.ensembles):
            m.write().overwrite().save(f"{path}/class-{k}")
        meta = json.dumps({"start": self.start, "features": self.features, "params": self.params})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "SoftmaxBoostModel":
        meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)
        models = [GBTRegressionModel.load(f"{path}/class-{k}") for k in range(len(meta["start"]))]
        return SoftmaxBoostModel(meta["start"], models, meta["features"], meta["params"])
