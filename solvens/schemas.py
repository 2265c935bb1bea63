"""Schemas, class names and other fixed values of the data model."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Class names in code order, label spellings, table columns.
# ---------------------------------------------------------------------------
CLASS_NAMES = ["Bankrupt", "Financial Distress", "Probably Bankrupt", "Healthy"]
HEALTHY = 3

LABEL_ALIASES = {
    "bankrupt": "Bankrupt",
    "probable bankrupt": "Probably Bankrupt",
    "probably bankrupt": "Probably Bankrupt",
    "financial distress": "Financial Distress",
    "healthy": "Healthy",
}

RATIO_COUNT = 66
RATIO_COLUMNS = [f"x{i}" for i in range(1, RATIO_COUNT + 1)]
ID_COLUMNS = ["Company", "Year", "Folder_name", "Feature_name"]
TARGET_COLUMN = "Target"

# Columns of the audited table that never enter a model.
NON_FEATURE_COLUMNS = ["Company", "Year", "Target", "Net_Worth"]

# Inputs of the rule label; dropping them removes the circularity of a model
# trained to predict a rule over its own features.
RULE_INPUTS = [
    "Equity Share Capital",
    "Reserves",
    "Interest_Coverage",
    "Debt_to_Equity",
    "Net profit",
    "Operating_Margin",
]

# Audited feature columns and the names shown to readers.
FEATURE_DISPLAY_NAMES = {
    "Interest_Coverage": "Interest Coverage Ratio",
    "Debt_to_Equity": "Debt-to-Equity Ratio",
    "Operating_Margin": "Operating Margin",
    "ROA": "Return on Assets (ROA)",
    "ROE": "Return on Equity (ROE)",
    "Working_Capital_Ratio": "Working Capital Ratio",
    "Cash_to_Debt": "Cash-to-Debt Ratio",
    "Net profit": "Net Profit",
    "Operating Profit": "Operating Profit (EBIT)",
    "Borrowings": "Total Debt / Borrowings",
    "Cash from Operating Activity": "Operating Cash Flow",
    "Borrowing_Growth": "Debt Growth (YoY)",
    "Revenue_Growth": "Sales Growth (YoY)",
    "Profit_Growth": "Net Profit Growth (YoY)",
    "Asset_Growth": "Asset Growth (YoY)",
    "Operating_CF_Growth": "Cash Flow Growth (YoY)",
    "Sales": "Sales Revenue",
    "Total Assets": "Total Assets",
    "Total Liabilities": "Total Liabilities",
    "Cash & Bank": "Cash & Liquid Balances",
    "Equity Share Capital": "Equity Share Capital",
    "Reserves": "Net Reserves & Surplus",
    "Profit_Margin": "Net Profit Margin",
    "Expense_Ratio": "Operating Expense Ratio",
    "Depreciation_Ratio": "Depreciation to Assets",
    "Asset_Utilization": "Asset Turnover / Utilization",
    "Receivable_Ratio": "Receivables to Sales",
    "Inventory_Ratio": "Inventory to Sales",
    "Operating_CF_Ratio": "Operating Cash Flow to Assets",
    "Cash_Margin": "Cash Flow Margin",
    "Net Cash Flow": "Net Cash Flow",
    "Profit before tax": "Profit Before Tax (PBT)",
    "Tax": "Tax Expense / Credit",
    "Depreciation": "Depreciation & Amortization",
    "Interest": "Finance Costs / Interest Expense",
    "Raw Material Cost": "Raw Material Expenses",
    "Employee Cost": "Employee & Personnel Cost",
    "Power and Fuel": "Power & Energy Costs",
    "Selling and admin": "Selling & Admin Expenses",
    "Other Expenses": "Other Operating Expenses",
    "Other Income": "Other Non-Operating Income",
    "Dividend Amount": "Dividends Paid",
    "Net Block": "Fixed Assets / Net Block",
    "Capital Work in Progress": "Capital WIP",
    "Investments": "Strategic Investments",
    "Other Assets": "Other Current / Non-Current Assets",
    "Other Liabilities": "Other Current Liabilities",
    "Receivables": "Trade Receivables",
    "Inventory": "Inventory Holdings",
    "Change in Inventory": "Inventory Change",
    "Revenue_CAGR_3Y": "3-Year Sales CAGR",
    "Profit_CAGR_3Y": "3-Year Net Profit CAGR",
    "Revenue_Volatility": "Sales Volatility",
    "Profit_Volatility": "Profit Volatility",
    "Operating_CF_Volatility": "Cash Flow Volatility",
    "Reserve_Growth": "Reserve Growth (YoY)",
    "Receivable_Growth": "Receivables Growth (YoY)",
    "Inventory_Growth": "Inventory Growth (YoY)",
    "Cash_Growth": "Cash Reserves Growth (YoY)",
}

AUDITED_FEATURES = list(FEATURE_DISPLAY_NAMES) + [
    "Cash from Investing Activity",
    "Cash from Financing Activity",
]

# Features allowed into the factor lists.
ESSENTIAL_FEATURES = [
    "Interest_Coverage",
    "Debt_to_Equity",
    "Operating_Margin",
    "Net profit",
    "Operating Profit",
    "Borrowings",
    "ROA",
    "ROE",
    "Cash_to_Debt",
    "Working_Capital_Ratio",
    "Cash from Operating Activity",
    "Borrowing_Growth",
    "Revenue_Growth",
    "Profit_Growth",
]


def raw_filing_schema(n_ratios: int = RATIO_COUNT) -> T.StructType:
    """Bronze schema: identifiers, label and ratio columns, all text as delivered."""
    names = ["Folder_name", "Feature_name", "Label"] + [f"x{i}" for i in range(1, n_ratios + 1)]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def audited_schema() -> T.StructType:
    return T.StructType(
        [T.StructField("Company", T.StringType(), False), T.StructField("Year", T.IntegerType(), False)]
        + [T.StructField(n, T.DoubleType(), True) for n in AUDITED_FEATURES]
    )


STATEMENT_SCHEMA = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("statement", T.StringType(), False),
        T.StructField("freq", T.StringType(), False),
        T.StructField("line_item", T.StringType(), False),
        T.StructField("period", T.DateType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)


def snake_name(name: str) -> str:
    """Column-safe spelling of a feature name."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower().replace("&", "and")).strip("_")


def name_map(names=None) -> dict[str, str]:
    """Feature name -> column-safe name; the inverse must be unique."""
    mapping = {n: snake_name(n) for n in (names or AUDITED_FEATURES)}
    if len(set(mapping.values())) != len(mapping):
        raise ValueError("two feature names share one column-safe spelling")
    return mapping
