"""Expressions over arrays: row statistics and probability vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvens.functions.numeric import col, round_half_even
from solvens.schemas import CLASS_NAMES, HEALTHY


def as_array(columns) -> Column:
    return F.array(*[col(c) for c in columns])


def row_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def row_std(values: Column) -> Column:
    """Sample standard deviation in two passes over the row."""
    mean = row_mean(values)
    squares = F.aggregate(F.transform(values, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1)))


def row_median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    low = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2


def argmax(probs) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    p = col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def percent_map(probs, names=CLASS_NAMES) -> Column:
    p = col(probs)
    shares = [round_half_even(F.element_at(p, i + 1) * 100, 2) for i in range(len(names))]
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*shares))


def confidence(probs) -> Column:
    return round_half_even(F.array_max(col(probs)) * 100, 2)


def _times(weight: float):
    return lambda v: v * weight


def weighted_blend(prob_columns: list, weights: list[float]) -> Column:
    """Class-wise weighted sum of several probability arrays."""
    if len(prob_columns) != len(weights):
        raise ValueError("one weight per probability column is needed")
    out = F.transform(col(prob_columns[0]), _times(weights[0]))
    for column, weight in zip(prob_columns[1:], weights[1:]):
        out = F.zip_with(out, F.transform(col(column), _times(weight)), lambda a, b: a + b)
    return out


def cascade_probabilities(gate, severity) -> Column:
    """Four class probabilities from P(healthy) and the three severity shares."""
    g, s = col(gate), col(severity)
    return F.concat(F.transform(s, lambda v: v * (1 - g)), F.array(g))


def cascade_class(gate, severity, threshold: float = 0.40) -> Column:
    """Healthy from the threshold on, else the most likely severity; the threshold
    may overrule the largest of the four combined probabilities."""
    return F.when(col(gate) >= threshold, F.lit(HEALTHY)).otherwise(argmax(severity))


def one_vs_rest(target, n_classes: int = len(CLASS_NAMES)) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (col(target) == k).cast("int"))
