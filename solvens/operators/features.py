"""Row-wise engineered features over imputed (NULL-free) ratios."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import as_array, row_mean, row_median, row_std
from solvens.functions.numeric import col

# The interaction terms; the guard keeps a zero denominator harmless.
QUOTIENTS = {"x1_div_x2": ("x1", "x2"), "x24_div_x45": ("x24", "x45"), "x13_div_x5": ("x13", "x5")}
PRODUCTS = {"x3_mul_x5": ("x3", "x5")}
EXTRA_PRODUCTS = {"x8_mul_x16": ("x8", "x16")}
QUOTIENT_GUARD = 1e-4
ROW_COUNTS = ("num_negative", "num_zero")
ROW_STATISTICS = ("mean_ratio", "std_ratio", "median_ratio")


def count_where(columns: list[str], test) -> Column:
    return sum((F.coalesce(test(col(c)).cast("int"), F.lit(0)) for c in columns[1:]),
               F.coalesce(test(col(columns[0])).cast("int"), F.lit(0)))


def row_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(
        {
            "num_negative": count_where(columns, lambda c: c < 0),
            "num_zero": count_where(columns, lambda c: c == 0),
        }
    )


def row_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    values = as_array(columns)
    return df.withColumns(
        {"mean_ratio": row_mean(values), "std_ratio": row_std(values), "median_ratio": row_median(values)}
    )


def guarded_quotient(a, b) -> Column:
    return col(a) / (F.abs(col(b)) + F.lit(QUOTIENT_GUARD))


def interactions(df: DataFrame, quotients=QUOTIENTS, products=PRODUCTS) -> DataFrame:
    out = {n: guarded_quotient(a, b) for n, (a, b) in quotients.items()}
    out.update({n: col(a) * col(b) for n, (a, b) in products.items()})
    return df.withColumns(out)


@dataclass(frozen=True)
class Terms:
    """Engineered features of one row, by name; ``counts`` and ``statistics`` look at all of a model's columns."""

    quotients: dict = field(default_factory=lambda: dict(QUOTIENTS))
    products: dict = field(default_factory=lambda: dict(PRODUCTS))
    counts: bool = True
    statistics: bool = True

    @property
    def names(self) -> list[str]:
        return [*(ROW_COUNTS if self.counts else ()), *(ROW_STATISTICS if self.statistics else ()), *self.quotients, *self.products]

    def add(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with the terms; ``columns`` hold no NULL."""
        out = row_counts(df, columns) if self.counts else df
        out = row_statistics(out, columns) if self.statistics else out
        return interactions(out, self.quotients, self.products)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Terms":
        given = json.loads(text)
        pairs = {k: {n: tuple(p) for n, p in given[k].items()} for k in ("quotients", "products")}
        return Terms(**{**given, **pairs})


#: Terms of the enhanced models; the second set has one more product.
ENHANCED = Terms()
ENHANCED_EXTRA = Terms(products={**PRODUCTS, **EXTRA_PRODUCTS})
