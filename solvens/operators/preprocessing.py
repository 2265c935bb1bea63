"""Imputer, scaler and correlation report: fitted on training rows, applied anywhere."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.numeric import col, nan_to_null, round_half_even
from solvens.session import materialise


#: Bins a range is cut into per pass.
MEDIAN_BINS = 4096


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Interpolated medians of many columns, exact, by counting.

    The first pass counts the values of each column and finds their range.  Every further pass cuts the range
    that holds the middle ranks into ``MEDIAN_BINS`` bins and gets count, smallest and largest value of
    each; a middle rank is read off when its bin holds one value only, or when it is the last of its bin
    and the next the first of the following one.  Counts are combined before the shuffle, so a value that fills a
    third of a column adds one row per task, and what reaches the driver is bounded by columns x bins.
    """
    if not columns:
        return {}
    rows = materialise(df.select(*[nan_to_null(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), "columns")
    extent = rows.agg(
        *[f(f"c{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    ).first()
    medians: dict[str, float | None] = {c: None for c in columns}
    pending = {}
    for i, c in enumerate(columns):
        n = extent[f"n{i}"]
        if n:
            pending[i] = {"low": extent[f"low{i}"], "high": extent[f"high{i}"], "skip": 0, "ranks": ((n + 1) // 2, (n + 2) // 2)}
    while pending:
        entries = []
        for i, p in pending.items():
            v, low, high = F.col(f"c{i}"), F.lit(p["low"]), F.lit(p["high"])
            # Halves, so that the width of a range of doubles can't overflow.
            share = (v / 2 - low / 2) / (high / 2 - low / 2) if p["high"] > p["low"] else F.lit(0.0)
            place = F.least(F.floor(share * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1)).cast("int")
            inside = (v >= low) & (v <= high)
            entries.append(F.struct(F.lit(i).alias("c"), F.when(inside, F.coalesce(place, F.lit(0))).alias("bin"), v.alias("v")))
        counted = (
            rows.select(F.inline(F.array(*entries)))
            .where("bin is not null")
            .groupBy("c", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        for i in list(pending):
            medians[columns[i]] = _narrow(pending[i], sorted((r.bin, r.n, r.low, r.high) for r in counted if r.c == i))
            if medians[columns[i]] is not None:
                del pending[i]
    return medians


def _narrow(state: dict, bins: list[tuple]) -> float | None:
    """The median, if the counts of the bins tell it; else the range in ``state`` becomes that of the middle ranks."""
    a, b = state["ranks"]
    before, found, kept = state["skip"], {}, []
    for _, n, low, high in bins:
        for rank in {a, b}:
            if before < rank <= before + n:
                kept.append((low, high, before))
                if low == high or rank == before + 1:
                    found[rank] = low
                elif rank == before + n:
                    found[rank] = high
        before += n
    if a in found and b in found:
        return found[a] / 2 + found[b] / 2
    state["low"], state["high"], state["skip"] = min(k[0] for k in kept), max(k[1] for k in kept), min(k[2] for k in kept)
    return None


@dataclass
class MedianImputer:
    """``fit`` reads training rows only; a column without any value stays NULL."""

    columns: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "MedianImputer":
        return MedianImputer(self.columns, exact_medians(df, self.columns))

    def transform(self, df: DataFrame) -> DataFrame:
        fill = {c: F.coalesce(nan_to_null(c), F.lit(self.medians.get(c)).cast("double")) for c in self.columns}
        return df.select(*[fill[c].alias(c) if c in fill else col(c) for c in df.columns])

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "medians": self.medians})

    @staticmethod
    def from_json(text: str) -> "MedianImputer":
        return MedianImputer(**json.loads(text))


@dataclass
class StandardScaler:
    """Centres and divides by the population deviation; a constant column is only centred."""

    columns: list[str]
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> "StandardScaler":
        row = df.agg(
            *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(self.columns)],
            *[F.stddev_pop(col(c)).alias(f"s{i}") for i, c in enumerate(self.columns)],
        ).first()
        means = {c: row[f"m{i}"] for i, c in enumerate(self.columns)}
        scales = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(self.columns)}
        return StandardScaler(self.columns, means, scales)

    def transform(self, df: DataFrame) -> DataFrame:
        chosen = set(self.columns)
        scaled = lambda c: (col(c) - F.lit(self.means[c])) / F.lit(self.scales[c])
        return df.select(*[scaled(c).alias(c) if c in chosen else col(c) for c in df.columns])

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "means": self.means, "scales": self.scales})

    @staticmethod
    def from_json(text: str) -> "StandardScaler":
        return StandardScaler(**json.loads(text))


def correlation_pairs(df: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """Feature pairs with ``abs(r) >= threshold``, strongest first.

    One distributed pass builds the p x p matrix; only its upper triangle
    (bounded by the number of features, not rows) becomes the report.  Constant
    columns have no correlation and drop out.
    """
    spark = df.sparkSession
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="error").transform(
        df.select(*[col(c).cast("double").alias(c) for c in columns])
    )
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()
    pairs = [
        (columns[i], columns[j], float(matrix[i, j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
        if not math.isnan(matrix[i, j]) and abs(matrix[i, j]) >= threshold
    ]
    out = spark.createDataFrame(pairs, "feature_1 string, feature_2 string, r double")
    return out.select(
        "feature_1",
        "feature_2",
        round_half_even("r", 4).alias("correlation"),
        round_half_even(F.abs("r"), 4).alias("abs_correlation"),
    ).orderBy(F.col("abs_correlation").desc(), "feature_1", "feature_2")


def features_vector(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=output).transform(df)


