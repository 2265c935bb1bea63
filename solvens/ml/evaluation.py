"""Evaluator for model selection by macro F1."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame

from solvens.operators.metrics import macro_metrics


class MacroF1Evaluator(Evaluator):
    """Unweighted mean F1 of the labels seen; Spark's own ``f1`` weighs by support."""

    def __init__(self, label: str = "target", pred: str = "pred", metric: str = "macro_f1"):
        super().__init__()
        self.label, self.pred, self.metric = label, pred, metric

    def _evaluate(self, dataset: DataFrame) -> float:
        row = macro_metrics(dataset, self.label, self.pred).first()
        return float(row[self.metric] or 0.0)

    def isLargerBetter(self) -> bool:
        return True
