"""Text functions: labels, tickers, value formatting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from solvens.functions.numeric import col, fixed_text, percent_text
from solvens.schemas import CLASS_NAMES, LABEL_ALIASES

# Name patterns of the value formatter, tested in this order.
MULTIPLE_PATTERN = "coverage|debt_to_equity|cash_to_debt"
PERCENT_PATTERN = "margin|roa|roe|growth|ratio"
CURRENCY_PATTERN = "sales|profit|borrowings|liabilities|assets|cash|reserves|cost|expense|tax|income"
CURRENCY_SIGN = "₹"
CURRENCY_UNIT = "Cr"


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def standard_label(label) -> Column:
    """Trimmed, lower-cased label looked up among the known spellings; NULL when unknown."""
    return F.try_element_at(literal_map(LABEL_ALIASES), F.lower(F.trim(col(label).cast("string"))))


def class_code(name) -> Column:
    return F.try_element_at(literal_map({n: i for i, n in enumerate(CLASS_NAMES)}), col(name))


def class_name(code) -> Column:
    return F.try_element_at(literal_map(dict(enumerate(CLASS_NAMES))), col(code).cast("int"))


def normalize_ticker(symbol) -> Column:
    """Upper-case symbol; a missing exchange suffix is added by the kind of symbol."""
    s = F.upper(F.trim(col(symbol)))
    return (
        F.when(F.contains(s, F.lit(".")), s)
        .when(s.rlike(r"^[0-9]+$"), F.concat(s, F.lit(".BO")))
        .otherwise(F.concat(s, F.lit(".NS")))
    )


def format_value(name, value) -> Column:
    """Reader-facing text of a feature value, chosen by the feature's name."""
    key, v = F.lower(col(name)), col(value)
    plain = fixed_text(v, 2)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit("N/A"))
        .when(key.rlike(MULTIPLE_PATTERN), F.concat(plain, F.lit("x")))
        .when(key.rlike(PERCENT_PATTERN), F.when(F.abs(v) < 10, percent_text(v)).otherwise(plain))
        .when(
            key.rlike(CURRENCY_PATTERN),
            F.concat(F.lit(CURRENCY_SIGN), fixed_text(v, 1, thousands=True), F.lit(f" {CURRENCY_UNIT}")),
        )
        .otherwise(plain)
    )


def parse_value(text, default: float = 0.0) -> Column:
    """Back from reader-facing text to a number; a percent sign divides by 100."""
    t = col(text)
    bare = F.trim(F.regexp_replace(t, f"{CURRENCY_SIGN}|{CURRENCY_UNIT}|x|%|,", ""))
    number = F.coalesce(bare.try_cast("double"), F.lit(float(default)))
    return F.when(F.contains(t, F.lit("%")), number / 100).otherwise(number)
