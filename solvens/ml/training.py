"""Training runs: prepared folds, grid search, cross-validation, cascade, comparison.

Imputer, scaler and oversampling are fitted inside each training part; nothing
of a validation or test part reaches them.
"""

from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax, cascade_class, cascade_probabilities
from solvens.functions.text import class_name
from solvens.ml import models
from solvens.ml.boosting import SoftmaxBoostModel
from solvens.ml.histogram import HistogramBoost, HistogramBoostModel
from solvens.ml.evaluation import MacroF1Evaluator
from solvens.ml.regression import SharedPipeline
from solvens.ml.stages import PreprocessModel
from solvens.operators.labels import binary_target, distressed_only
from solvens.operators.features import Terms
from solvens.operators.metrics import class_table, macro_metrics
from solvens.operators.preprocessing import MedianImputer, StandardScaler, features_vector
from solvens.operators.resampling import smote
from solvens.operators.splitting import with_class_weights
from solvens.schemas import CLASS_NAMES
from solvens.session import materialise


@dataclass
class Prepared:
    """Fitted preprocessing; ``transform`` gives rows a ``features`` vector.

    ``columns`` are read from the rows, ``inputs`` reach the model: the columns and the engineered ``terms`` of their imputed values.
    """

    columns: list[str]
    imputer: MedianImputer
    scaler: StandardScaler | None
    terms: Terms | None = None

    @property
    def inputs(self) -> list[str]:
        return [*self.columns, *(self.terms.names if self.terms else ())]

    @staticmethod
    def fit(train: DataFrame, columns: list[str], scaled: bool = False, terms: Terms | None = None) -> "Prepared":
        out = Prepared(columns, MedianImputer(columns).fit(train), None, terms)
        return replace(out, scaler=StandardScaler(out.inputs).fit(out.table(train))) if scaled else out

    def table(self, df: DataFrame) -> DataFrame:
        out = self.imputer.transform(df)
        out = self.terms.add(out, self.columns) if self.terms else out
        return self.scaler.transform(out) if self.scaler else out

    def transform(self, df: DataFrame) -> DataFrame:
        return features_vector(self.table(df), self.inputs)

    def stage(self) -> PreprocessModel:
        """The same as a Spark ML stage."""
        return PreprocessModel(imputer=self.imputer.to_json(), scaler=self.scaler.to_json() if self.scaler else "", terms=self.terms.to_json() if self.terms else "")

    def save(self, path: str) -> None:
        self.stage().write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "Prepared":
        imputer, scaler, terms = PreprocessModel.load(path).parts()
        return Prepared(imputer.columns, imputer, scaler, terms)


@dataclass
class Trained:
    """A named model with the preprocessing it was fitted on."""

    name: str
    prepared: Prepared
    model: object

    def score(self, df: DataFrame) -> DataFrame:
        return score_with(self.model, self.prepared.transform(df))

    def save(self, spark, path: str) -> None:
        """Model, preprocessing and name below ``path``; all that scoring needs."""
        self.prepared.save(f"{path}/prepared")
        boosted = isinstance(self.model, HistogramBoostModel)
        if boosted:
            self.model.save(spark, f"{path}/model")
        else:
            PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        meta = spark.createDataFrame([(self.name, boosted)], "name string, boosted boolean")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "Trained":
        meta = spark.read.schema("name string, boosted boolean").json(f"{path}/meta").first()
        model = HistogramBoostModel.load(spark, f"{path}/model") if meta.boosted else PipelineModel.load(f"{path}/model").stages[0]
        return Trained(meta.name, Prepared.load(f"{path}/prepared"), model)


def score_with(model, df: DataFrame) -> DataFrame:
    """Adds ``probs`` (array) and ``pred`` whatever the kind of model."""
    if isinstance(model, (SoftmaxBoostModel, HistogramBoostModel)):
        return model.transform(df)
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
        return out.withColumn("pred", argmax("probs")).drop("probability", "rawPrediction")
    # One-vs-rest: each class's margin as a probability, made to sum to one.
    margins = vector_to_array("rawPrediction")
    odds = F.transform(margins, lambda m: 1 / (1 + F.exp(-2 * m)))
    whole = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    out = out.withColumn("probs", odds).withColumn("probs", F.transform("probs", lambda v: v / whole))
    return out.withColumn("pred", F.col("pred").cast("int")).drop("rawPrediction")


def rebalance(train: DataFrame, prepared: Prepared, target: str, row_id: str, method: str | None) -> tuple[DataFrame, str | None]:
    """Training vectors and the weight column, by ``smote``, ``weights`` or neither."""
    if method == "smote":
        rows = smote(prepared.table(train), prepared.inputs, target, row_id)
        return features_vector(rows, prepared.inputs), None
    rows = prepared.transform(train)
    if method == "weights":
        return with_class_weights(rows, target), "weight"
    return rows, None


def train_model(name: str, train: DataFrame, columns: list[str], target: str = "target", row_id: str = "row_id", balance: str | None = None, overrides: dict | None = None, terms: Terms | None = None) -> Trained:
    """Fit one preset on training rows; oversampling happens in scaled space for scaled models."""
    preset = models.PRESETS[name]
    prepared = Prepared.fit(train, columns, preset.scaled, terms)
    rows, weight = rebalance(train, prepared, target, row_id, balance)
    rows = materialise(rows.select("features", target, *([weight] if weight else [])), "train")
    n = rows.count() if preset.kind == "lr" else 0
    estimator = models.build(name, n, overrides, label=target, weight=weight)
    return Trained(name, prepared, estimator.fit(rows))


def fold_parts(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(column) != fold), df.filter(F.col(column) == fold)


@dataclass
class FoldData:
    """One fold with everything fitted on its training part: training vectors and validation vectors, written once."""

    fold: int
    train: DataFrame
    valid: DataFrame
    weight: str | None
    rows: int
    keep: list[str] = field(default_factory=list)


def prepare_folds(name: str, df: DataFrame, columns: list[str], target: str = "target", row_id: str = "row_id", balance: str | None = None, fold: str = "fold", parallelism: int = 5) -> list[FoldData]:
    """All folds that the table has, each with its own imputer, scaler and oversampling; folds are prepared side by side."""
    scaled = models.PRESETS[name].scaled

    def prepare(f: int) -> FoldData:
        train, valid = fold_parts(df, f, fold)
        prepared = Prepared.fit(train, columns, scaled)
        rows, weight = rebalance(train, prepared, target, row_id, balance)
        rows = materialise(rows.select("features", target, *([weight] if weight else [])), "fold-train")
        keep = [row_id, target, fold]
        return FoldData(f, rows, materialise(prepared.transform(valid).select(*keep, "features"), "fold-valid"), weight, rows.count(), keep)

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(prepare, sorted(r[0] for r in df.select(fold).distinct().collect())))


def out_of_fold(name: str, folds: list[FoldData], target: str = "target", overrides: dict | None = None, parallelism: int = 2) -> DataFrame:
    """Predictions of every row by the model fitted without its fold."""

    def part(f: FoldData) -> DataFrame:
        estimator = models.build(name, f.rows, overrides, label=target, weight=f.weight)
        return score_with(estimator.fit(f.train), f.valid).select(*f.keep, "pred")

    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(part, folds))


def cross_validate(name: str, df: DataFrame, columns: list[str], target: str = "target", row_id: str = "row_id", balance: str | None = None, overrides: dict | None = None) -> DataFrame:
    """Out-of-fold predictions (row_id, target, fold, pred) over all folds of the table; ``metrics.cv_summary`` condenses them."""
    return out_of_fold(name, prepare_folds(name, df, columns, target, row_id, balance), target, overrides)


def grid_points(grid: dict) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


def staged_points(name: str, points: list[dict]) -> list[list[int]]:
    """Places of the points, together if one boosted run serves them."""
    if models.PRESETS[name].kind != "boost":
        return [[i] for i in range(len(points))]
    groups: dict[tuple, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault(tuple(sorted((k, v) for k, v in p.items() if k != "rounds")), []).append(i)
    return list(groups.values())


def staged_out_of_fold(name: str, folds: list[FoldData], target: str, points: list[dict]) -> DataFrame:
    """``out_of_fold`` of every point (``stage``: its place), from one run per fold; the points differ in ``rounds`` only."""
    parts = []
    most = max(points, key=lambda p: p["rounds"])
    for f in folds:
        model = models.build(name, f.rows, most, label=target, weight=f.weight).fit(f.train)
        for stage, p in enumerate(points):
            parts.append(model.first_rounds(p["rounds"]).transform(f.valid).select(F.lit(stage).alias("stage"), *f.keep, "pred"))
    return reduce(DataFrame.unionByName, parts)


def grid_search(name: str, df: DataFrame, columns: list[str], grid: dict | None = None, target: str = "target", row_id: str = "row_id", balance: str | None = None, parallelism: int = 4) -> tuple[dict, DataFrame, Trained]:
    """Best hyperparameters by mean macro F1 over all folds of the table, all scores, and a refit on all rows.

    Imputer, scaler and oversampling are fitted once per fold; the points share them and run side by side.  Points of a boosted model that
    differ in ``rounds`` only are one run of the most rounds, judged at each: its first trees are those of the shorter runs.
    """
    points = grid_points(grid or models.GRIDS[name])
    folds = prepare_folds(name, df, columns, target, row_id, balance)

    def summary(i: int, scored: DataFrame) -> tuple:
        row = macro_metrics(scored, target, "pred", ["fold"]).agg(F.avg("macro_f1").alias("f1"), F.avg("accuracy").alias("acc"), F.sum("support").alias("rows")).first()
        return i, str(points[i]), float(row.f1), float(row.acc), int(row.rows)

    def judge(group: list[int]) -> list[tuple]:
        if len(group) == 1:
            return [summary(group[0], out_of_fold(name, folds, target, points[group[0]]))]
        scored = materialise(staged_out_of_fold(name, folds, target, [points[i] for i in group]), "staged")
        return [summary(i, scored.filter(F.col("stage") == stage)) for stage, i in enumerate(group)]

    with ThreadPoolExecutor(parallelism) as pool:
        scores = sorted(itertools.chain.from_iterable(pool.map(judge, staged_points(name, points))))
    best = points[max(scores, key=lambda s: (s[2], -s[0]))[0]]
    table = df.sparkSession.createDataFrame(scores, "point int, params string, macro_f1 double, accuracy double, rows long")
    return best, table, train_model(name, df, columns, target, row_id, balance, best)


def spark_grid_search(estimator, param_maps, df: DataFrame, fold: str = "fold", folds: int = 5, target: str = "target", parallelism: int = 4):
    """Spark's own ``CrossValidator`` on the given folds, judged by macro F1.

    ``estimator`` is a pipeline that begins with ``stages.Preprocess``: it is fitted anew on each training part, once for all points that share it.
    """
    if type(estimator) is Pipeline:
        estimator = SharedPipeline(stages=estimator.getStages())
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=param_maps,
        evaluator=MacroF1Evaluator(target),
        numFolds=folds,
        foldCol=fold,
        parallelism=parallelism,
    ).fit(df)


def logistic_grid(estimator, n_rows: int, strengths=tuple(models.GRIDS["logistic_regression"]["C"])):
    return ParamGridBuilder().addGrid(estimator.regParam, [1.0 / (c * n_rows) for c in strengths]).build()


# --- cascade -------------------------------------------------------------------


@dataclass
class Cascade:
    """Gate (healthy or not) and severity model for the rest."""

    prepared: Prepared
    gate: HistogramBoostModel
    severity: HistogramBoostModel
    threshold: float = 0.40

    def score(self, df: DataFrame, threshold: float | None = None) -> DataFrame:
        cut = self.threshold if threshold is None else threshold
        rows = self.gate.transform(self.prepared.transform(df), probs="_gate", pred="_g")
        rows = self.severity.transform(rows, probs="severity", pred="_s").withColumn("gate", F.col("_gate")[1]).drop("_gate", "_g", "_s")
        return rows.withColumn("probs", cascade_probabilities("gate", "severity")).withColumn(
            "pred", cascade_class("gate", "severity", cut)
        )

    def save(self, spark, path: str) -> None:
        self.prepared.save(f"{path}/prepared")
        self.gate.save(spark, f"{path}/gate")
        self.severity.save(spark, f"{path}/severity")
        spark.createDataFrame([(float(self.threshold),)], "threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @staticmethod
    def load(spark, path: str) -> "Cascade":
        gate, severity = (HistogramBoostModel.load(spark, f"{path}/{part}") for part in ("gate", "severity"))
        meta = spark.read.schema("threshold double").json(f"{path}/meta").first()
        return Cascade(Prepared.load(f"{path}/prepared"), gate, severity, meta.threshold)


def train_cascade(train: DataFrame, columns: list[str], target: str = "target", row_id: str = "row_id", balance: str | None = "smote", rounds: int = 300, depth: int = 6, step: float = 0.08, subsample: float = 0.85, seed: int = 42, terms: Terms | None = None) -> Cascade:
    """Gate on all rows, severity on the distressed ones, each rebalanced on its own, both on columns and engineered ``terms``."""
    prepared = Prepared.fit(train, columns, terms=terms)
    params = {"rounds": rounds, "max_depth": depth, "learning_rate": step, "subsample": subsample, "seed": seed}

    def fit(rows: DataFrame, label: str, classes: int) -> HistogramBoostModel:
        vectors, weight = rebalance(rows, prepared, label, row_id, balance)
        return HistogramBoost(classes=classes, label=label, weight=weight, **params).fit(vectors)

    gate = fit(train.withColumn("healthy", binary_target(target)), "healthy", 2)
    return Cascade(prepared, gate, fit(distressed_only(train, target), target, len(CLASS_NAMES) - 1))


# --- comparison ----------------------------------------------------------------


def compare_balancing(names: list[str], df: DataFrame, columns: list[str], target: str = "target", row_id: str = "row_id", overrides: dict | None = None, fold: str = "fold", parallelism: int = 5) -> DataFrame:
    """Out-of-fold predictions of each model under class weights and under oversampling, over all folds of the table.

    Folds run side by side.  Medians and deviations are fitted once per fold and serve all models and both ways; models that see the same
    space share its oversampled rows.  Predictions are written as soon as a fold has them.
    """
    df = df.select(row_id, target, fold, *columns)

    def run(f: int) -> DataFrame:
        train, valid = fold_parts(df, f, fold)
        fitted = Prepared.fit(train, columns, True)
        spaces = {scaled: fitted if scaled else Prepared(columns, fitted.imputer, None) for scaled in {models.PRESETS[n].scaled for n in names}}
        parts = []
        for scaled, prepared in spaces.items():
            judged = materialise(prepared.transform(valid).select(row_id, target, fold, "features"), "fold-valid")
            for method in ("weights", "smote"):
                rows, weight = rebalance(train, prepared, target, row_id, method)
                rows = materialise(rows.select("features", target, *([weight] if weight else [])), "fold-train")
                n = rows.count()
                for name in (m for m in names if models.PRESETS[m].scaled == scaled):
                    estimator = models.build(name, n, (overrides or {}).get(name), label=target, weight=weight)
                    scored = score_with(estimator.fit(rows), judged)
                    parts.append(scored.select(F.lit(name).alias("model"), F.lit(method).alias("balance"), row_id, target, fold, "pred"))
        return materialise(reduce(DataFrame.unionByName, parts), "predictions")

    numbers = sorted(r[0] for r in df.select(fold).distinct().collect())
    with ThreadPoolExecutor(parallelism) as pool:
        return reduce(DataFrame.unionByName, pool.map(run, numbers))


def held_out_predictions(trained: list[Trained], test: DataFrame, target: str = "target", keys: list[str] = ("row_id",)) -> DataFrame:
    """Predictions of several models on the test part, long by model."""
    out = None
    for t in trained:
        part = t.score(test).select(F.lit(t.name).alias("model"), *keys, target, "pred")
        out = part if out is None else out.unionByName(part)
    return out


def importances(model: Trained) -> list[float]:
    """How much each input counts, summing to 1: split gains, a forest's own importances, or mean absolute coefficients of scaled inputs."""
    fitted = model.model
    if isinstance(fitted, HistogramBoostModel):
        return fitted.feature_importances(len(model.prepared.inputs))
    if hasattr(fitted, "featureImportances"):
        return [float(v) for v in fitted.featureImportances.toArray()]
    size = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    return [float(v) for v in size / (size.sum() or 1.0)]


def result_table(predictions: DataFrame, fitted: list[Trained], target: str = "target") -> DataFrame:
    """(model, section, entry, value): averages, F1 and support of each class, importances; from the models' held-out predictions."""
    average = macro_metrics(predictions, target, "pred", ["model"])
    names = [c for c in average.columns if c != "model"]
    line = lambda section, entry, value: F.struct(F.lit(section).alias("section"), entry.alias("entry"), value.cast("double").alias("value"))
    averages = average.select("model", F.inline(F.array(*[line("average", F.lit(c), F.col(c)) for c in names])))
    classes = class_table(predictions, target, "pred", ["model"])
    of_class = [line(f"class {c}", class_name("label"), F.col(c)) for c in ("precision", "recall", "f1", "support")]
    classes = classes.select("model", F.inline(F.array(*of_class)))
    weights = [(m.name, "importance", n, v) for m in fitted for n, v in zip(m.prepared.inputs, importances(m), strict=True)]
    table = predictions.sparkSession.createDataFrame(weights, "model string, section string, entry string, value double")
    return averages.unionByName(classes).unionByName(table)


def importance_table(spark, importances: list[float], names: list[str], k: int = 20) -> DataFrame:
    """The ``k`` most important features (a list as long as the features, not the rows)."""
    pairs = [(n, float(v)) for n, v in zip(names, importances)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)
