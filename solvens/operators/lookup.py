"""Positional lookups: latest, first, searched and sampled rows.

First-row-per-group lookups are aggregates (``min_by``/``max_by``), so map tasks
send one row per group and no group has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.functions.ordering import stable_key
from solvens.schemas import AUDITED_FEATURES


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def latest_filing(df: DataFrame, company: str = "company", year: str = "year") -> DataFrame:
    return (
        df.groupBy(F.col(company).alias("_k")).agg(F.max_by(_whole_row(df), F.col(year)).alias("_r")).select("_r.*")
    )


def company_list(df: DataFrame, company: str = "company") -> DataFrame:
    return df.select(company).distinct().orderBy(company)


def company_history(df: DataFrame, name: str, company: str = "company", year: str = "year") -> DataFrame:
    return df.filter(F.col(company) == name).orderBy(year)


def company_search(df: DataFrame, pattern: str, position: str, company: str = "company", limit: int = 10) -> DataFrame:
    """Distinct companies matching a case-insensitive pattern, in order of first
    appearance; the report shows ``limit`` of them."""
    hit = F.coalesce(F.col(company).rlike(f"(?i){pattern}"), F.lit(False))
    return (
        df.filter(hit)
        .groupBy(company)
        .agg(F.min(position).alias("first_position"))
        .orderBy("first_position", company)
        .limit(limit)
    )


def first_per_class(df: DataFrame, target: str, order: list[str]) -> DataFrame:
    return (
        df.groupBy(F.col(target).alias("_k"))
        .agg(F.min_by(_whole_row(df), F.struct(*order)).alias("_r"))
        .select("_r.*")
    )


def random_per_class(df: DataFrame, target: str, keys: list[str], seed: int = 42) -> DataFrame:
    """One row per class, chosen by a seeded digest of the row key."""
    return (
        df.groupBy(F.col(target).alias("_k"))
        .agg(F.min_by(_whole_row(df), stable_key(*keys, seed=seed)).alias("_r"))
        .select("_r.*")
    )


def seeded_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), the same ones on every run."""
    return df.orderBy(stable_key(*keys, seed=seed), *keys).limit(n)


def scenario_filter(df: DataFrame, scenarios: dict[str, Column], order: list[str]) -> DataFrame:
    """First row of each scenario by ``order``, all scenarios in one scan."""
    rank, row = F.struct(*order), _whole_row(df)
    picked = df.agg(
        *[F.min_by(row, F.when(rule, rank)).alias(f"_s{i}") for i, rule in enumerate(scenarios.values())]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("scenario"), F.col(f"_s{i}").alias("_r")) for i, n in enumerate(scenarios)]
    )
    return picked.select(F.inline(rows)).filter(F.col("_r").isNotNull()).select("scenario", "_r.*")


def demo_scenarios(profit="net_profit", leverage="debt_to_equity", coverage="interest_coverage") -> dict[str, Column]:
    # One range test per class.
    return {
        "Bankrupt": (F.col(profit) < -1000) & (F.col(leverage) > 5.0),
        "Financial Distress": (F.col(coverage) < 2.0) & (F.col(coverage) > 1.0),
        "Probably Bankrupt": (F.col(coverage) < 1.0) & (F.col(coverage) > 0),
        "Healthy": (F.col(coverage) > 10.0) & (F.col(profit) > 500),
    }


# What-if presets (name, sales, profit, debt, capital, reserves,
# debt/equity, coverage, margin).
PRESETS = [
    ("Healthy Blue-Chip Company", 5000.0, 600.0, 400.0, 100.0, 2500.0, 0.15, 20.0, 0.20),
    ("Overleveraged / Stressed Company", 1800.0, 30.0, 1800.0, 80.0, 400.0, 3.75, 1.4, 0.04),
    ("High Default Risk (Probably Bankrupt)", 900.0, -150.0, 2500.0, 50.0, 100.0, 8.0, 0.3, -0.08),
    ("Insolvent / Net Worth Eroded (Bankrupt)", 400.0, -600.0, 3500.0, 50.0, -800.0, -4.6, -2.0, -0.30),
]
PRESET_SCHEMA = (
    "scenario string, sales double, net_profit double, borrowings double, equity_capital double, "
    "reserves double, debt_to_equity double, interest_coverage double, operating_margin double"
)


def presets(spark) -> DataFrame:
    rows = spark.createDataFrame(PRESETS, PRESET_SCHEMA)
    return rows.withColumn("equity", F.col("equity_capital") + F.col("reserves"))


def scenario_vectors(df: DataFrame, key: list[str], features: list[str] = AUDITED_FEATURES) -> DataFrame:
    """What-if rows (seven inputs) in the model's feature layout; the rest stays NULL for the imputer."""
    given = {
        "Sales": F.col("sales"),
        "Net profit": F.col("net_profit"),
        "Borrowings": F.col("borrowings"),
        "Equity Share Capital": F.col("equity") * 0.25,
        "Reserves": F.col("equity") * 0.75,
        "Debt_to_Equity": F.col("debt_to_equity"),
        "Interest_Coverage": F.col("interest_coverage"),
        "Operating_Margin": F.col("operating_margin"),
    }
    return df.select(*key, *[given.get(f, F.lit(None).cast("double")).alias(f) for f in features])
