"""Numeric column helpers with one null model: NaN never gets past a boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decimal or scientific notation, or a spelled infinity.  Java-only forms such
# as ``1.0d`` or ``0x1p3`` are refused although a bare cast would take them.
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
FINITE_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(f"`{c}`")


def nan_to_null(c) -> Column:
    """NULL compares as unknown, NaN compares as larger than everything; keep only NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def to_double(c, allow_inf: bool = True) -> Column:
    """Text to double after removing double quotes and outer blanks; anything else is NULL."""
    text = F.trim(F.replace(col(c).cast("string"), F.lit('"'), F.lit("")))
    pattern = NUMBER_PATTERN if allow_inf else FINITE_PATTERN
    return F.when(text.rlike(pattern), text.try_cast("double"))


def guarded_ratio(num, den, default) -> Column:
    """``num / den`` where the denominator is positive, else ``default``."""
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(default)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def fixed_text(x, digits: int, thousands: bool = False) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value.

    ``round`` and ``format_string`` work on the shortest decimal text of a
    double and would turn 2.675 into 2.68; ``format_number`` does not.
    """
    pattern = ("#,##0" if thousands else "0") + "." + "0" * digits
    return F.call_function("format_number", col(x).cast("double"), F.lit(pattern))


def round_half_even(x, digits: int) -> Column:
    x = col(x).cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, fixed_text(x, digits).cast("double")).otherwise(x)


def percent_text(x, digits: int = 1) -> Column:
    return F.concat(fixed_text(col(x) * 100, digits), F.lit("%"))
