"""Batch scoring by model name, and statements to scores."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax, weighted_blend
from solvens.functions.text import class_name
from solvens.ml.attribution import attribution_items, tree_attributions
from solvens.ml.training import Cascade, Trained
from solvens.operators import statements as st
from solvens.operators.cleaning import align_features
from solvens.operators.reporting import risk_report
from solvens.schemas import AUDITED_FEATURES


@dataclass
class Registry:
    """Fitted models by name; each has ``score(df)`` adding ``probs`` and ``pred``."""

    models: dict[str, Trained | Cascade] = field(default_factory=dict)

    def add(self, name: str, model) -> "Registry":
        self.models[name] = model
        return self

    def score(self, name: str, df: DataFrame, keys: list[str] = ()) -> DataFrame:
        """Align ``df`` to the model's features and score all rows."""
        if name not in self.models:
            raise KeyError(f"no model named {name}; known: {sorted(self.models)}")
        model = self.models[name]
        scored = model.score(align_features(df, model.prepared.columns, list(keys)))
        return scored.withColumn("prediction", class_name("pred"))

    def blend(self, weights: dict[str, float], df: DataFrame, key: str) -> DataFrame:
        """Weighted mean of several models' probabilities, all computed on the same row: no join, and repeated keys stay apart."""
        columns = []
        rows = df.select(key, F.struct(*[c for c in df.columns if c != key]).alias("_in"))
        for i, name in enumerate(weights):
            model = self.models[name]
            given = align_features(rows.select("*", "_in.*"), model.prepared.columns, [key, "_in", *columns])
            rows = model.score(given).select(key, "_in", *columns, F.col("probs").alias(f"probs_{i}"))
            columns.append(f"probs_{i}")
        mixed = rows.withColumn("probs", weighted_blend(columns, list(weights.values())))
        return mixed.withColumn("pred", argmax("probs")).drop("_in", *columns)


def score_statements(statements: DataFrame, model: Trained | Cascade, features: list[str] = AUDITED_FEATURES, scale: float = st.SCALE) -> DataFrame:
    """Landed statements of many tickers to scored rows: pick, default, ratio, impute, score."""
    return model.score(st.feature_vector(statements, features, scale)).withColumn("prediction", class_name("pred"))


def explain_scores(scored: DataFrame, model: Trained, keys: list[str]) -> DataFrame:
    """Attributions of the predicted class for rows scored by a boosted model."""
    return tree_attributions(model.model, scored, keys, model.prepared.inputs)


# Columns of a scored statement that a report shows, and their names there.
REPORT_COLUMNS = {
    "Sales": "sales",
    "Net profit": "net_profit",
    "Borrowings": "borrowings",
    "Interest_Coverage": "interest_coverage",
    "Debt_to_Equity": "debt_to_equity",
    "Operating_Margin": "operating_margin",
    "ROA": "roa",
    "ROE": "roe",
    "Working_Capital_Ratio": "working_capital_ratio",
}


def explained_statements(statements: DataFrame, model: Trained, features: list[str] = AUDITED_FEATURES, scale: float = st.SCALE) -> DataFrame:
    """Landed statements to rows of a report: vector, score and the attributions of the predicted class by the scoring model itself.

    One aggregation per ticker; scoring and explaining are projections of the ticker's row.  ``model`` is a boosted model or a forest whose columns
    are among ``features``; what a report shows is there whether the model sees it or not.
    """
    rows = st.feature_vector(statements, list(dict.fromkeys([*features, *REPORT_COLUMNS])), scale)
    rows = rows.withColumns({c: F.col(f) for f, c in REPORT_COLUMNS.items()})
    scored = model.score(rows)
    keep = ["ticker", "latest_period", *REPORT_COLUMNS.values(), "probs"]
    return attribution_items(model.model, scored, keep, model.prepared.inputs).withColumnRenamed("class_id", "explained")


def live_reports(statements: DataFrame, model: Trained, features: list[str] = AUDITED_FEATURES, scale: float = st.SCALE, concise: bool = False) -> DataFrame:
    """Landed statements of many tickers to risk reports, one document per accepted ticker."""
    rows = explained_statements(statements, model, features, scale)
    subtitle = F.concat(F.lit("Statements up to "), F.coalesce(F.col("latest_period").cast("string"), F.lit("N/A")))
    return risk_report(rows, ["ticker", "latest_period"], F.col("ticker"), subtitle, concise=concise)
