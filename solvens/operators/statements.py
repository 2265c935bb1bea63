"""From landed statements in long form to the model's feature vector.

A statement row is (ticker, statement, freq, line_item, period, value).  One
aggregation per ticker picks every metric: conditional ``min_by`` keeps a value
and a rank per metric, combines on the map side and needs no join or pivot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from solvens.functions.numeric import guarded_ratio, nan_to_null
from solvens.functions.text import normalize_ticker
from solvens.schemas import AUDITED_FEATURES

STATEMENTS = ("income", "balance", "cashflow")
FREQUENCIES = ("annual", "quarterly")


@dataclass(frozen=True)
class Metric:
    name: str
    statement: str
    candidates: tuple[str, ...]


# Line items per metric, first match first.
METRICS = [
    Metric("sales", "income", ("Total Revenue", "Operating Revenue", "Gross Revenue")),
    Metric(
        "net_profit",
        "income",
        ("Net Income", "Net Income Common Stockholders", "Net Income From Continuing Operation Net Minority Interest"),
    ),
    Metric("operating_profit", "income", ("Operating Income", "EBIT", "Normalized EBITDA")),
    Metric("interest", "income", ("Interest Expense", "Interest Expense Non Operating", "Net Interest Income")),
    Metric(
        "depreciation",
        "income",
        (
            "Reconciled Depreciation",
            "Depreciation And Amortization In Income Statement",
            "Depreciation Amortization Depletion",
        ),
    ),
    Metric("pbt", "income", ("Pretax Income",)),
    Metric("tax", "income", ("Tax Provision",)),
    Metric("borrowings", "balance", ("Total Debt", "Long Term Debt And Capital Lease Obligation", "Long Term Debt")),
    Metric("equity", "balance", ("Stockholders Equity", "Common Stock Equity", "Total Equity Gross Minority Interest")),
    Metric("assets", "balance", ("Total Assets",)),
    Metric("liabilities", "balance", ("Total Liabilities Net Minority Interest", "Total Liabilities")),
    Metric(
        "cash",
        "balance",
        ("Cash And Cash Equivalents", "Cash Cash Equivalents And Short Term Investments", "Cash Financial"),
    ),
    Metric("receivables", "balance", ("Receivables", "Accounts Receivable")),
    Metric("inventory", "balance", ("Inventory",)),
    Metric("working_capital", "balance", ("Working Capital",)),
    Metric("ocf", "cashflow", ("Operating Cash Flow", "Cash Flowsfromusedin Operating Activities")),
    Metric("icf", "cashflow", ("Investing Cash Flow", "Cash Flowsfromusedin Investing Activities")),
    Metric("fcf", "cashflow", ("Financing Cash Flow", "Cash Flowsfromusedin Financing Activities")),
]

GROWTH_METRICS = [
    Metric("revenue_growth", "income", ("Total Revenue", "Operating Revenue")),
    Metric("profit_growth", "income", ("Net Income", "Net Income Common Stockholders")),
    Metric("borrowing_growth", "balance", ("Total Debt",)),
    Metric("asset_growth", "balance", ("Total Assets",)),
]

# Plain defaults; the chained ones are in ``apply_defaults``.
DEFAULTS = {
    "sales": 100.0,
    "net_profit": 5.0,
    "operating_profit": 10.0,
    "interest": 2.0,
    "depreciation": 5.0,
    "borrowings": 50.0,
    "equity": 50.0,
    "assets": 150.0,
    "cash": 10.0,
    "receivables": 15.0,
    "inventory": 10.0,
    "icf": -10.0,
    "fcf": -5.0,
}
SCALE = 1e7

# Constants of the guarded ratios.
GUARDS = {
    "coverage_profit": 5.0,
    "coverage_loss": -1.0,
    "leverage_debt": 10.0,
    "leverage_none": -5.0,
    "operating_margin": 0.05,
    "profit_margin": 0.05,
    "roa": 0.05,
    "roe": 0.05,
    "working_capital_ratio": 0.05,
    "asset_utilization": 0.5,
    "receivable_ratio": 0.1,
    "inventory_ratio": 0.1,
    "cash_to_debt": 1.0,
    "cash_margin": 0.05,
    "expense_ratio": 0.8,
    "depreciation_ratio": 0.03,
    "equity_fallback": 10.0,
    "equity_share": 0.25,
    "reserve_share": 0.75,
}


def _recency(df: DataFrame, period: str) -> Column:
    """A number that grows with the period, whether it is a date or a year."""
    kind = dict(df.dtypes)[period]
    return F.unix_date(F.col(period)) if kind == "date" else F.col(period).cast("bigint")


def statement_source(df: DataFrame) -> DataFrame:
    """Frequency used per ticker and statement; ``accepted`` needs a balance sheet and an income statement."""
    seen = {
        (s, f): F.max(((F.col("statement") == s) & (F.col("freq") == f)).cast("int")) == 1
        for s in STATEMENTS
        for f in FREQUENCIES
    }
    flags = df.groupBy("ticker").agg(*[c.alias(f"_{s}_{f}") for (s, f), c in seen.items()])
    chosen = {
        s: F.when(F.col(f"_{s}_annual"), F.lit("annual")).when(F.col(f"_{s}_quarterly"), F.lit("quarterly"))
        for s in STATEMENTS
    }
    out = flags.select("ticker", *[c.alias(f"{s}_freq") for s, c in chosen.items()])
    return out.withColumn("accepted", F.col("income_freq").isNotNull() & F.col("balance_freq").isNotNull())


def rejected_tickers(df: DataFrame) -> DataFrame:
    """Tickers left out of scoring, with the reason."""
    missing = F.when(F.col("income_freq").isNull(), F.lit("income statement missing")).otherwise(
        F.lit("balance sheet missing")
    )
    return statement_source(df).filter(~F.col("accepted")).select("ticker", missing.alias("reason"))


def _candidate_rank(metric: Metric) -> Column:
    rank = None
    for i, item in enumerate(metric.candidates):
        hit = F.col("line_item") == item
        rank = F.when(hit, i) if rank is None else rank.when(hit, i)
    return F.when(F.col("statement") == metric.statement, rank)


def raw_metrics(df: DataFrame, metrics: list[Metric] = METRICS, scale: float = SCALE, period: str = "period") -> DataFrame:
    """Newest value of the first candidate that has any, per ticker and metric, over ``scale``.

    Annual rows count when a statement has any, else quarterly ones do; both
    are aggregated side by side and the choice is made afterwards.
    """
    value = nan_to_null("value")
    age = F.lit(2_000_000) - _recency(df, period)
    picks, flags = [], []
    for freq in FREQUENCIES:
        here = F.col("freq") == freq
        for m in metrics:
            rank = _candidate_rank(m).cast("bigint") * 10_000_000 + age
            picks.append(F.min_by(value, F.when(here & value.isNotNull(), rank)).alias(f"_{m.name}_{freq}"))
        for s in STATEMENTS:
            flags.append(F.max(((F.col("statement") == s) & here).cast("int")).alias(f"_has_{s}_{freq}"))
    newest = [
        F.max(F.when((F.col("statement") == "income") & (F.col("freq") == f), F.col(period))).alias(f"_latest_{f}")
        for f in FREQUENCIES
    ]
    wide = df.groupBy("ticker").agg(*picks, *flags, *newest)

    def chosen(name: str, statement: str) -> Column:
        annual = F.col(f"_has_{statement}_annual") == 1
        return F.when(annual, F.col(f"_{name}_annual")).otherwise(F.col(f"_{name}_quarterly"))

    present = {s: F.greatest(f"_has_{s}_annual", f"_has_{s}_quarterly") == 1 for s in STATEMENTS}
    return wide.select(
        "ticker",
        (present["income"] & present["balance"]).alias("accepted"),
        chosen("latest", "income").alias("latest_period"),
        *[(chosen(m.name, m.statement) / F.lit(scale)).alias(m.name) for m in metrics],
    )


def apply_defaults(df: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Fill absent metrics; later defaults build on earlier metrics."""
    v = F.col
    out = df.withColumns({m: F.coalesce(v(m), F.lit(d)) for m, d in defaults.items()})
    out = out.withColumns({"interest": F.abs("interest"), "depreciation": F.abs("depreciation")})
    out = out.withColumn("pbt", F.coalesce(v("pbt"), v("net_profit") * 1.25))
    gap = F.when(v("pbt") > v("net_profit"), F.abs(v("pbt") - v("net_profit"))).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "tax": F.coalesce(v("tax"), gap),
            "liabilities": F.coalesce(v("liabilities"), v("assets") - v("equity")),
            "working_capital": F.coalesce(v("working_capital"), v("assets") * 0.1),
            "ocf": F.coalesce(v("ocf"), v("operating_profit") * 0.8),
        }
    )


def statement_metrics(df: DataFrame, scale: float = SCALE, period: str = "period") -> DataFrame:
    """All metrics of every ticker that has both required statements, defaults applied."""
    return apply_defaults(raw_metrics(df, METRICS, scale, period).filter("accepted")).drop("accepted")


def ratio_block(df: DataFrame, guards: dict = GUARDS) -> DataFrame:
    """Fourteen ratios; a denominator that is not positive yields the guard value."""
    g, v = guards, F.col
    coverage_guard = F.when(v("operating_profit") > 0, g["coverage_profit"]).otherwise(g["coverage_loss"])
    leverage_guard = F.when(v("borrowings") > 0, g["leverage_debt"]).otherwise(g["leverage_none"])
    over = {
        "interest_coverage": ("operating_profit", "interest", coverage_guard),
        "debt_to_equity": ("borrowings", "equity", leverage_guard),
        "operating_margin": ("operating_profit", "sales", g["operating_margin"]),
        "profit_margin": ("net_profit", "sales", g["profit_margin"]),
        "roa": ("net_profit", "assets", g["roa"]),
        "roe": ("net_profit", "equity", g["roe"]),
        "working_capital_ratio": ("working_capital", "assets", g["working_capital_ratio"]),
        "asset_utilization": ("sales", "assets", g["asset_utilization"]),
        "receivable_ratio": ("receivables", "sales", g["receivable_ratio"]),
        "inventory_ratio": ("inventory", "sales", g["inventory_ratio"]),
        "cash_to_debt": ("cash", "borrowings", g["cash_to_debt"]),
        "cash_margin": ("ocf", "sales", g["cash_margin"]),
        "depreciation_ratio": ("depreciation", "assets", g["depreciation_ratio"]),
    }
    ratios = {name: guarded_ratio(num, den, d) for name, (num, den, d) in over.items()}
    ratios["expense_ratio"] = guarded_ratio(v("sales") - v("operating_profit"), "sales", g["expense_ratio"])
    return df.withColumns(ratios)


def growth_rates(df: DataFrame, metrics: list[Metric] = GROWTH_METRICS, period: str = "period", default: float = 0.0) -> DataFrame:
    """Change between the two newest values of the first candidate that has two and a
    non-zero older one.

    The ranking keeps two rows per line item, values before gaps; Spark applies
    such a limit before the shuffle as well (WindowGroupLimit), so long
    histories do not travel.  Line items without a use count as one item, of which
    two rows tell whether its statement is reported annually.
    """
    items = sorted({(m.statement, c) for m in metrics for c in m.candidates})
    value = nan_to_null("value")
    item = F.when(F.col("line_item").isin([c for _, c in items]), F.col("line_item"))
    newest_first = W.partitionBy("ticker", "statement", "freq", "line_item").orderBy(
        F.col("_v").isNull(), F.col(period).desc()
    )
    two = (
        df.select("ticker", "statement", "freq", item.alias("line_item"), period, value.alias("_v"))
        .withColumn("_rn", F.row_number().over(newest_first))
        .filter("_rn <= 2")
    )
    aggs = [
        F.max(((F.col("statement") == s) & (F.col("freq") == "annual")).cast("int")).alias(f"_has_{s}")
        for s in STATEMENTS
    ]
    for freq in FREQUENCIES:
        for i, (s, c) in enumerate(items):
            here = (F.col("freq") == freq) & (F.col("statement") == s) & (F.col("line_item") == c)
            for n in (1, 2):
                aggs.append(F.max(F.when(here & (F.col("_rn") == n), F.col("_v"))).alias(f"_{freq}_{i}_{n}"))
    both = two.groupBy("ticker").agg(*aggs)
    place = {key: i for i, key in enumerate(items)}

    def change(freq: str, statement: str, candidate: str) -> Column:
        i = place[(statement, candidate)]
        new, old = F.col(f"_{freq}_{i}_1"), F.col(f"_{freq}_{i}_2")
        return F.when(old != 0, (new - old) / F.abs(old))

    def growth(m: Metric) -> Column:
        by_freq = [F.coalesce(*[change(f, m.statement, c) for c in m.candidates], F.lit(default)) for f in FREQUENCIES]
        return F.when(F.col(f"_has_{m.statement}") == 1, by_freq[0]).otherwise(by_freq[1])

    return both.select("ticker", *[growth(m).alias(m.name) for m in metrics])


# Feature name -> metric column of the assembled row.
FEATURE_SOURCES = {
    "Sales": "sales",
    "Net profit": "net_profit",
    "Operating Profit": "operating_profit",
    "Interest": "interest",
    "Depreciation": "depreciation",
    "Profit before tax": "pbt",
    "Tax": "tax",
    "Borrowings": "borrowings",
    "Equity Share Capital": "equity_share_capital",
    "Reserves": "reserves",
    "Total Assets": "assets",
    "Total Liabilities": "liabilities",
    "Cash & Bank": "cash",
    "Receivables": "receivables",
    "Inventory": "inventory",
    "Cash from Operating Activity": "ocf",
    "Cash from Investing Activity": "icf",
    "Cash from Financing Activity": "fcf",
    "Net Cash Flow": "net_cash_flow",
    "Interest_Coverage": "interest_coverage",
    "Debt_to_Equity": "debt_to_equity",
    "Operating_Margin": "operating_margin",
    "Profit_Margin": "profit_margin",
    "ROA": "roa",
    "ROE": "roe",
    "Working_Capital_Ratio": "working_capital_ratio",
    "Asset_Utilization": "asset_utilization",
    "Receivable_Ratio": "receivable_ratio",
    "Inventory_Ratio": "inventory_ratio",
    "Cash_to_Debt": "cash_to_debt",
    "Cash_Margin": "cash_margin",
    "Expense_Ratio": "expense_ratio",
    "Depreciation_Ratio": "depreciation_ratio",
    "Revenue_Growth": "revenue_growth",
    "Profit_Growth": "profit_growth",
    "Borrowing_Growth": "borrowing_growth",
    "Asset_Growth": "asset_growth",
}


def equity_split(df: DataFrame, guards: dict = GUARDS) -> DataFrame:
    """Capital and reserves as fixed shares of equity, and the sum of the three cash flows."""
    e = F.col("equity")
    return df.withColumns(
        {
            "equity_share_capital": F.when(e > 0, e * guards["equity_share"]).otherwise(guards["equity_fallback"]),
            "reserves": F.when(e > 0, e * guards["reserve_share"]).otherwise(e),
            "net_cash_flow": F.col("ocf") + F.col("icf") + F.col("fcf"),
        }
    )


def feature_vector(df: DataFrame, features: list[str] = AUDITED_FEATURES, scale: float = SCALE, period: str = "period") -> DataFrame:
    """One row per accepted ticker in the model's layout; slots without a source are NULL."""
    rows = equity_split(ratio_block(statement_metrics(df, scale, period)))
    rows = rows.join(growth_rates(df, period=period), "ticker", "left")
    return rows.select(
        "ticker",
        "latest_period",
        *[
            (F.col(FEATURE_SOURCES[f]) if f in FEATURE_SOURCES else F.lit(None).cast("double")).alias(f)
            for f in features
        ],
    )


def company_meta(df: DataFrame, scale: float = SCALE) -> DataFrame:
    """Name, sector, price and size of a ticker; blanks and zeros count as absent."""
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    ticker = normalize_ticker("ticker")
    positive = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return df.select(
        ticker.alias("ticker"),
        F.coalesce(present("short_name"), present("long_name"), ticker).alias("company_name"),
        F.coalesce(present("sector"), F.lit("N/A")).alias("sector"),
        F.coalesce(present("industry"), F.lit("N/A")).alias("industry"),
        F.coalesce(F.col("market_cap") / F.lit(scale), F.lit(0.0)).alias("market_cap_cr"),
        F.coalesce(positive("current_price"), positive("regular_market_price"), F.lit(0.0)).alias("current_price"),
        F.coalesce(present("currency"), F.lit("INR")).alias("currency"),
    )


def period_text(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- filing histories --------------------------------------------------------


def _company_years(company: str, year: str):
    # Filings are unique by company and year, so one company's group is bounded by its years.
    return W.partitionBy(company).orderBy(year)


def growth_history(df: DataFrame, columns: dict[str, str], company: str = "company", year: str = "year") -> DataFrame:
    """Change against the previous filing, (new - old) / abs(old), per column."""
    w = _company_years(company, year)

    def change(c):
        old = F.lag(c).over(w)
        return F.when(old != 0, (F.col(c) - old) / F.abs(old))

    return df.withColumns({name: change(c) for name, c in columns.items()})


def trend_history(df: DataFrame, columns: dict[str, str], company: str = "company", year: str = "year", span: int = 3, window: int = 5) -> DataFrame:
    """``<name>_CAGR_3Y`` over ``span`` filings and ``<name>_Volatility``, the sample
    deviation of the last ``window`` filings.  These two formulas are our own."""
    w = _company_years(company, year)
    recent = w.rowsBetween(-(window - 1), 0)
    out = {}
    for name, c in columns.items():
        past = F.lag(c, span).over(w)
        out[f"{name}_CAGR_{span}Y"] = F.when((past > 0) & (F.col(c) > 0), F.pow(F.col(c) / past, F.lit(1.0 / span)) - 1)
        out[f"{name}_Volatility"] = F.stddev_samp(c).over(recent)
    return df.withColumns(out)
