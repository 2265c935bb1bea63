"""Imputer and scaler as one Spark ML stage, so that pipelines and cross-validators fit them on their training parts."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from solvens.operators.features import Terms
from solvens.operators.preprocessing import MedianImputer, StandardScaler, features_vector


class _Shared(Params):
    outputCol = Param(Params._dummy(), "outputCol", "name of the vector column", TypeConverters.toString)


class Preprocess(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation, scaling if asked for, and assembly of ``columns`` into one vector."""

    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)
    scaled = Param(Params._dummy(), "scaled", "whether features are standardised", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns=None, scaled=False, outputCol="features"):
        super().__init__()
        self._setDefault(scaled=False, outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "PreprocessModel":
        columns = self.getOrDefault("columns")
        imputer = MedianImputer(columns).fit(df)
        scaler = StandardScaler(columns).fit(imputer.transform(df)) if self.getOrDefault("scaled") else None
        return PreprocessModel(imputer=imputer.to_json(), scaler=scaler.to_json() if scaler else "", outputCol=self.getOrDefault("outputCol"))


class PreprocessModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted stage; its medians, means and deviations are parameters and are saved with it."""

    imputer = Param(Params._dummy(), "imputer", "fitted imputer as JSON", TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "fitted scaler as JSON, empty for none", TypeConverters.toString)
    terms = Param(Params._dummy(), "terms", "engineered features as JSON, empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, imputer=None, scaler=None, terms=None, outputCol="features"):
        super().__init__()
        self._setDefault(scaler="", terms="", outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def parts(self) -> tuple[MedianImputer, StandardScaler | None, Terms | None]:
        imputer, scaler, terms = (self.getOrDefault(p) for p in ("imputer", "scaler", "terms"))
        return MedianImputer.from_json(imputer), StandardScaler.from_json(scaler) if scaler else None, Terms.from_json(terms) if terms else None

    def _transform(self, df: DataFrame) -> DataFrame:
        imputer, scaler, terms = self.parts()
        out = imputer.transform(df)
        out = terms.add(out, imputer.columns) if terms else out
        inputs = [*imputer.columns, *(terms.names if terms else ())]
        return features_vector(scaler.transform(out) if scaler else out, inputs, self.getOrDefault("outputCol"))
