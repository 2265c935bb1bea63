"""Target columns: the solvency rule, overrides and binary views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.functions.numeric import col
from solvens.schemas import CLASS_NAMES, HEALTHY

# Cut-offs of the solvency rule.
DEFAULT_CUTOFFS = {
    "insolvent_coverage": -1.0,
    "insolvent_profit": -100.0,
    "weak_coverage": 1.0,
    "weak_leverage": 4.0,
    "loss_coverage": 1.5,
    "watch_coverage": 2.5,
    "watch_leverage": 2.0,
    "watch_margin": 0.02,
}


def net_worth(equity="Equity Share Capital", reserves="Reserves") -> Column:
    return col(equity) + col(reserves)


def rule_label(
    net_worth: Column,
    coverage="interest_coverage",
    profit="net_profit",
    leverage="debt_to_equity",
    margin="operating_margin",
    cutoffs: dict | None = None,
) -> Column:
    """Class code by rule, most severe test first; a NULL input fails its test only."""
    k = {**DEFAULT_CUTOFFS, **(cutoffs or {})}
    ic, np_, de, om = col(coverage), col(profit), col(leverage), col(margin)
    bankrupt = (net_worth < 0) | ((ic < k["insolvent_coverage"]) & (np_ < k["insolvent_profit"]))
    probable = (ic < k["weak_coverage"]) | (de > k["weak_leverage"]) | ((np_ < 0) & (ic < k["loss_coverage"]))
    distress = (ic < k["watch_coverage"]) | (de > k["watch_leverage"]) | (om < k["watch_margin"])
    return F.when(bankrupt, 0).when(probable, 2).when(distress, 1).otherwise(HEALTHY)


# Companies whose healthy label was found to be wrong.
KNOWN_DISTRESSED = [
    "alok industries ltd.",
    "shree renuka sugars ltd.",
    "iti ltd.",
    "cg power and industrial solutions ltd.",
    "mmtc ltd.",
    "monnet ispat & energy limited",
]


def override_labels(
    df: DataFrame,
    companies: list[str] | DataFrame = KNOWN_DISTRESSED,
    company: str = "company",
    target: str = "target",
    from_class: int = HEALTHY,
    to_class: int = 1,
) -> DataFrame:
    """Move listed companies out of ``from_class``; matching ignores case and outer blanks.

    A Python list becomes an ``isin``.  A DataFrame (one column) is joined, and
    Spark picks the join by its size.  Apply to training rows only unless the
    evaluation is meant to use edited labels.
    """
    key = F.lower(F.trim(F.col(company)))
    if isinstance(companies, DataFrame):
        names = companies.toDF("_name").select(F.lower(F.trim("_name")).alias("_name")).distinct()
        df = df.join(names.withColumn("_listed", F.lit(True)), key == F.col("_name"), "left").drop("_name")
        hit = F.coalesce("_listed", F.lit(False))
    else:
        hit = key.isin([c.strip().lower() for c in companies])
    return df.withColumn(
        target, F.when(hit & (F.col(target) == from_class), F.lit(to_class)).otherwise(F.col(target))
    ).drop("_listed")


def binary_target(target="target") -> Column:
    return (col(target) == HEALTHY).cast("int")


def distressed_only(df: DataFrame, target: str = "target") -> DataFrame:
    return df.filter(F.col(target) != HEALTHY)


def class_names_dim(df_or_spark) -> DataFrame:
    """Four-row dimension (code, name); its size is fixed, so it may be broadcast."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "code int, name string")
