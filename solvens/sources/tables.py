"""Company-year tables derived from the order tables.

They stand for the filings, statements, scores and attributions the operators
work on.  Money is summed as integer cents, so no partitioning changes a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvens.operators.labels import rule_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c):
    return F.round(c * 100).cast("bigint")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order year.

    Orders are summed per customer key and year before the customer table is
    joined, so that join moves one row per filing and not one per order.
    """
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(_cents(price)).alias("gross_c"),
            F.sum(_cents(price * discount)).alias("disc_c"),
            F.sum(F.when(F.col("l_returnflag") == "R", _cents(price)).otherwise(0)).alias("ret_c"),
        )
    )
    order_c = _cents(F.col("o_totalprice"))
    yearly = (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(
            F.sum("gross_c").alias("sales_c"),
            F.sum("disc_c").alias("disc_c"),
            F.sum("ret_c").alias("ret_c"),
            F.sum(F.when(F.col("o_orderstatus") == "P", order_c).otherwise(0)).alias("debt_c"),
            F.sum(order_c).alias("tot_c"),
        )
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    base = yearly.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("company"),
        "year",
        (F.col("sales_c").cast("double") / 100000).alias("sales"),
        ((F.col("sales_c") * 55 - F.col("ret_c") * 100 - F.col("disc_c") * 100).cast("double") / 10000000).alias(
            "operating_profit"
        ),
        ((F.col("tot_c") * 2).cast("double") / 10000000).alias("interest"),
        (F.col("debt_c").cast("double") / 100000).alias("borrowings"),
        F.lit(100.0).alias("equity_share_capital"),
        (F.round(F.col("c_acctbal") * 10) / 100).alias("reserves"),
    )
    worth = F.col("equity_share_capital") + F.col("reserves")
    return base.select(
        "*",
        (F.col("operating_profit") - F.col("interest")).alias("net_profit"),
        F.when(F.col("interest") > 0, F.col("operating_profit") / F.col("interest")).alias("interest_coverage"),
        F.when(worth != 0, F.col("borrowings") / worth).alias("debt_to_equity"),
        F.when(F.col("sales") > 0, F.col("operating_profit") / F.col("sales")).alias("operating_margin"),
    )


FILING_FEATURES = [
    "sales",
    "operating_profit",
    "interest",
    "borrowings",
    "equity_share_capital",
    "reserves",
    "net_profit",
    "interest_coverage",
    "debt_to_equity",
    "operating_margin",
]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).withColumn("target", rule_label(net_worth=F.col("equity_share_capital") + F.col("reserves")))


def _rows(df: DataFrame, keep: list, fields: list[str], tuples: list[tuple]) -> DataFrame:
    """Several output rows per input row from one pass over the input."""
    structs = [F.struct(*[v.alias(n) for n, v in zip(fields, t)]) for t in tuples]
    return df.select(*keep, F.inline(F.array(*structs)))


def statements_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    crore = F.lit(10000000)
    sales, year = F.col("sales"), F.col("year")

    def line(statement, item, value):
        return F.lit(statement), F.lit("annual"), F.lit(item), year, value

    rows = [
        line("income", "Total Revenue", F.when(year % 5 == 0, F.lit(None).cast("double")).otherwise(sales * crore)),
        line("income", "Operating Revenue", sales * F.lit(9000000)),
        line("income", "Net Income", F.col("net_profit") * crore),
        line("income", "Operating Income", F.col("operating_profit") * crore),
        line("income", "Interest Expense", -F.col("interest") * crore),
        line("balance", "Total Debt", F.col("borrowings") * crore),
        line("balance", "Stockholders Equity", (F.col("equity_share_capital") + F.col("reserves")) * crore),
    ]
    return _rows(
        filings(spark, sf_dir),
        [F.col("company").alias("ticker")],
        ["statement", "freq", "line_item", "period", "value"],
        rows,
    )


def raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings as delivered: quoted numbers, stray blanks, ``NA``, label spellings."""
    year = F.col("year")
    label = (
        F.when(F.col("target") == 0, F.lit("Bankrupt"))
        .when(F.col("target") == 1, F.lit(" FINANCIAL DISTRESS"))
        .when(
            F.col("target") == 2,
            F.when(year % 2 == 0, F.lit("Probable Bankrupt")).otherwise(F.lit("probably bankrupt ")),
        )
        .when((year == 1999) & (F.col("sales") < 100), F.lit(None).cast("string"))
        .otherwise(F.lit("Healthy"))
    )
    as_text = lambda c: _cents(F.col(c)).cast("string")
    return labelled(spark, sf_dir).select(
        F.concat(F.lit(" "), F.col("company"), F.lit(" ")).alias("folder_name"),
        year.cast("string").alias("feature_name"),
        label.alias("label"),
        F.when(year % 7 == 0, F.lit("NA")).otherwise(F.concat(F.lit('"'), as_text("sales"), F.lit('"'))).alias("x1"),
        F.when(F.col("borrowings") == 0, F.lit(""))
        .otherwise(F.concat(F.lit(" "), as_text("borrowings"), F.lit(" ")))
        .alias("x2"),
        as_text("net_profit").alias("x3"),
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic class probabilities from the distance of coverage to four centres."""
    base = labelled(spark, sf_dir)
    near = near_centres()
    raw = base.select("company", "year", "target", *[r.alias(f"r{i}") for i, r in enumerate(near)])
    whole = F.col("r0") + F.col("r1") + F.col("r2") + F.col("r3")
    return raw.select("company", "year", "target", *[(F.col(f"r{i}") / whole).alias(f"p{i}") for i in range(4)])


def _attribution_rows() -> list[tuple]:
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    return [
        (F.lit("Interest_Coverage"), F.lit(0.10) * (v("interest_coverage") - 3), F.col("interest_coverage")),
        (F.lit("Debt_to_Equity"), F.lit(-0.20) * (v("debt_to_equity") - 0.5), F.col("debt_to_equity")),
        (F.lit("Operating_Margin"), F.lit(2.0) * (v("operating_margin") - 0.10), F.col("operating_margin")),
        (F.lit("Net profit"), F.lit(0.001) * (F.col("net_profit") - 50), F.col("net_profit")),
        (F.lit("Sales"), F.lit(0.0005) * (F.col("sales") - 300), F.col("sales")),
    ]


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic per-row feature attributions, one line per feature."""
    keep = ["company", "year", "target"]
    return _rows(labelled(spark, sf_dir), keep, ["feature", "phi", "actual"], _attribution_rows())


def scored_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with their class probabilities and attributions as arrays, in one projection."""
    items = F.array(
        *[F.struct(f.alias("feature"), p.alias("phi"), a.alias("actual")) for f, p, a in _attribution_rows()]
    )
    near = near_centres()
    whole = near[0] + near[1] + near[2] + near[3]
    return labelled(spark, sf_dir).select("*", F.array(*[n / whole for n in near]).alias("probs"), items.alias("items"))


def near_centres() -> list:
    return [1 / (1 + F.abs(F.coalesce("interest_coverage", F.lit(0)) - F.lit(c))) for c in (-2, 1.75, 0.5, 4)]
