"""Model presets by name, and the pipelines built from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier

from solvens.ml.histogram import HistogramBoost
from solvens.ml.regression import NewtonRegression

# Spark limits tree depth to 30; "unlimited" is mapped to it.
UNLIMITED_DEPTH = 30


@dataclass(frozen=True)
class Preset:
    """``kind``: lr, rf, et, boost; ``scaled`` models see standardised features."""

    kind: str
    params: dict
    scaled: bool = False


# Tuned and fixed hyperparameters of the two training runs.
PRESETS = {
    "logistic_regression": Preset("lr", {"C": 10.0, "max_iter": 2000}, scaled=True),
    "random_forest": Preset("rf", {"trees": 200, "depth": None, "min_leaf": 1}),
    "boost_a": Preset("boost", {"rounds": 200, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample": 0.8}),
    "boost_b": Preset("boost", {"rounds": 250, "max_depth": 6, "learning_rate": 0.1, "l2": 3.0}),
    "boost_c": Preset("boost", {"rounds": 200, "max_depth": 10, "learning_rate": 0.1, "max_leaves": 31}),
    "extra_trees": Preset("et", {"trees": 300, "depth": 20}),
    "boost_enhanced": Preset("boost", {"rounds": 350, "max_depth": 6, "learning_rate": 0.07, "subsample": 0.85, "colsample": 0.85}),
    "audited_logistic_regression": Preset("lr", {"C": 1.0, "max_iter": 2000}, scaled=True),
    "audited_random_forest": Preset("rf", {"trees": 250, "depth": 20, "min_leaf": 1}),
    "audited_boost_a": Preset("boost", {"rounds": 350, "max_depth": 6, "learning_rate": 0.08, "subsample": 0.85, "colsample": 0.85}),
    "audited_boost_b": Preset("boost", {"rounds": 350, "max_depth": 6, "learning_rate": 0.08}),
    "audited_boost_c": Preset("boost", {"rounds": 350, "max_depth": 10, "learning_rate": 0.08}),
}

# Search grids.
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "random_forest": {"trees": [100, 200], "depth": [10, 15, 20, None], "min_leaf": [1, 2]},
    "boost_a": {
        "rounds": [100, 200],
        "max_depth": [4, 6, 8],
        "learning_rate": [0.05, 0.1],
        "subsample": [0.8, 1.0],
        "colsample": [0.8, 1.0],
    },
    "boost_b": {"rounds": [150, 250], "max_depth": [4, 6], "learning_rate": [0.05, 0.1]},
    "boost_c": {"rounds": [100, 200], "max_depth": [6, 10], "learning_rate": [0.05, 0.1]},
}

BLEND_WEIGHTS = {"boost_a": 0.35, "boost_c": 0.30, "boost_b": 0.20, "extra_trees": 0.15}


def logistic_regression(n_rows: int, C: float = 1.0, max_iter: int = 2000, features="features", label="target", weight=None):
    """L2-penalised multinomial regression; the penalty is stated as inverse strength ``C``.

    Spark averages the loss over rows, so the strength is divided by their number.
    """
    lr = NewtonRegression(
        featuresCol=features,
        labelCol=label,
        family="multinomial",
        elasticNetParam=0.0,
        regParam=1.0 / (C * max(n_rows, 1)),
        standardization=False,
        maxIter=max_iter,
        predictionCol="pred",
        probabilityCol="probability",
    )
    return lr.setWeightCol(weight) if weight else lr


def random_forest(trees: int = 200, depth: int | None = None, min_leaf: int = 1, bootstrap: bool = True, max_bins: int = 64, seed: int = 42, features="features", label="target", weight=None):
    rf = RandomForestClassifier(
        featuresCol=features,
        labelCol=label,
        numTrees=trees,
        maxDepth=depth or UNLIMITED_DEPTH,
        minInstancesPerNode=min_leaf,
        bootstrap=bootstrap,
        maxBins=max_bins,
        seed=seed,
        predictionCol="pred",
        probabilityCol="probability",
    )
    return rf.setWeightCol(weight) if weight else rf


def extra_trees(trees: int = 300, depth: int = 20, **kw):
    """Approximation: every tree sees all rows and random features, but split points
    are searched and not drawn at random."""
    return random_forest(trees, depth, bootstrap=False, **kw)


def one_vs_rest_boosting(rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42, features="features", label="target"):
    """Spark's binary boosting, one model per class."""
    base = GBTClassifier(featuresCol=features, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    return OneVsRest(classifier=base, featuresCol=features, labelCol=label, predictionCol="pred")


def build(name: str, n_rows: int, overrides: dict | None = None, features="features", label="target", weight=None):
    """Estimator of a preset; ``overrides`` replaces single hyperparameters."""
    preset = PRESETS[name]
    params = {**preset.params, **(overrides or {})}
    common = {"features": features, "label": label, "weight": weight}
    if preset.kind == "lr":
        return logistic_regression(n_rows, **params, **common)
    if preset.kind == "rf":
        return random_forest(**params, **common)
    if preset.kind == "et":
        return extra_trees(**params, **common)
    return HistogramBoost(**params, **common)
