"""Statements to metrics, ratios, growth and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.operators import statements as st
from solvens.plans.base import with_tables
from solvens.plans.ingest import ticker_symbols
from solvens.sources import tables

VECTOR_COLUMNS = {
    "Sales": "sales",
    "Equity Share Capital": "equity_share_capital",
    "Reserves": "reserves",
    "Net Cash Flow": "net_cash_flow",
    "Interest_Coverage": "interest_coverage",
    "Expense_Ratio": "expense_ratio",
    "Revenue_Growth": "revenue_growth",
    "Borrowing_Growth": "borrowing_growth",
    "Operating_CF_Ratio": "operating_cf_ratio",
}


def mixed_statements(spark, d) -> DataFrame:
    """Statements where some tickers report a statement quarterly or not at all."""
    df = tables.statements_long(spark, d)
    key = F.substring("ticker", -1, 1)
    income = F.col("statement") == "income"
    quarterly = ((key == "1") & income) | (key == "2")
    kept = ~(((key == "3") & income) | ((key == "4") & ~income))
    odd = F.col("period") % 2 == 1
    mixed = (key == "5") & odd
    return df.filter(kept).withColumn("freq", F.when(quarterly | mixed, F.lit("quarterly")).otherwise(F.col("freq")))


def statement_metrics(spark, d):
    return st.statement_metrics(tables.statements_long(spark, d))


def raw_statement_metrics(spark, d):
    picked = st.raw_metrics(mixed_statements(spark, d))
    return picked.select("ticker", "accepted", "latest_period", "sales", "net_profit", "operating_profit", "interest", "borrowings", "equity", "assets")


def statement_source(spark, d):
    return st.statement_source(mixed_statements(spark, d))


def rejected_tickers(spark, d):
    return st.rejected_tickers(mixed_statements(spark, d))


def statement_defaults(spark, d):
    df = tables.filings(spark, d).select(
        F.col("company"),
        "year",
        "sales",
        F.when(F.col("year") % 2 == 0, F.col("net_profit")).alias("net_profit"),
        "operating_profit",
        (-F.col("interest")).alias("interest"),
        F.lit(None).cast("double").alias("depreciation"),
        F.when(F.col("year") % 3 == 0, F.col("operating_profit")).alias("pbt"),
        F.lit(None).cast("double").alias("tax"),
        F.when(F.col("year") % 5 != 0, F.col("borrowings")).alias("borrowings"),
        F.col("reserves").alias("equity"),
        F.when(F.col("year") % 2 == 1, F.col("sales") * 2).alias("assets"),
        *[F.lit(None).cast("double").alias(c) for c in ("liabilities", "cash", "receivables", "inventory", "working_capital", "ocf", "icf", "fcf")],
    )
    return st.apply_defaults(df)


def ratio_block(spark, d):
    metrics = st.statement_metrics(tables.statements_long(spark, d))
    ratios = st.ratio_block(metrics)
    return ratios.select("ticker", *[c for c in ratios.columns if c not in metrics.columns])


def feature_vector(spark, d):
    out = st.feature_vector(tables.statements_long(spark, d))
    return out.select("ticker", "latest_period", *[F.col(f"`{f}`").alias(a) for f, a in VECTOR_COLUMNS.items()])


def yoy_growth(spark, d):
    return st.growth_rates(tables.statements_long(spark, d))


def yoy_growth_mixed(spark, d):
    return st.growth_rates(mixed_statements(spark, d))


def growth_history(spark, d):
    df = tables.filings(spark, d).select("company", "year", "sales", "net_profit", "borrowings")
    names = {"sales_growth": "sales", "profit_growth": "net_profit", "borrowing_growth": "borrowings"}
    return st.growth_history(df, names).select("company", "year", *names)


def cagr_volatility(spark, d):
    df = tables.filings(spark, d)
    out = st.trend_history(df, {"revenue": "sales", "profit": "net_profit"})
    names = ["revenue_CAGR_3Y", "revenue_Volatility", "profit_CAGR_3Y", "profit_Volatility"]
    return out.select("company", "year", *[F.round(c, 6).alias(c.lower()) for c in names])


def company_meta(spark, d):
    c = tables.table(spark, d, "customer").join(ticker_symbols(spark, d), "c_custkey")
    key = F.col("c_custkey")
    meta = c.select(
        F.col("symbol").alias("ticker"),
        F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.col("c_name")).alias("short_name"),
        F.when(key % 2 == 0, F.concat(F.col("c_name"), F.lit(" Limited"))).alias("long_name"),
        F.col("c_mktsegment").alias("sector"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.lower("c_mktsegment")).alias("industry"),
        F.when(key % 7 != 0, F.col("c_acctbal") * 10000000).alias("market_cap"),
        F.when(key % 4 == 0, F.lit(0.0)).when(key % 4 == 1, F.col("c_acctbal")).alias("current_price"),
        F.when(key % 2 == 0, F.col("c_acctbal") / 2).alias("regular_market_price"),
        F.when(key % 6 == 0, F.lit("USD")).alias("currency"),
    )
    return st.company_meta(meta)


def latest_period(spark, d):
    df = tables.statements_long(spark, d).filter("statement = 'income'")
    newest = df.groupBy("ticker").agg(F.max(F.make_date("period", F.lit(12), F.lit(31))).alias("newest"))
    return newest.select("ticker", st.period_text("newest").alias("period"))


QUERIES = {
    "statement_metrics": statement_metrics,
    "raw_statement_metrics": raw_statement_metrics,
    "statement_source": statement_source,
    "rejected_tickers": rejected_tickers,
    "statement_defaults": statement_defaults,
    "ratio_block": ratio_block,
    "feature_vector": feature_vector,
    "yoy_growth": yoy_growth,
    "yoy_growth_mixed": yoy_growth_mixed,
    "growth_history": growth_history,
    "cagr_volatility": cagr_volatility,
    "company_meta": company_meta,
    "latest_period": latest_period,
}


def _newest(item: str, source: str = "statements_long", where: str = "") -> str:
    """Newest value of one line item per ticker."""
    return f"(select ticker, arg_max(value, period) as v from {source} where line_item='{item}' and value is not null {where} group by ticker)"


# The proxy statements hold one candidate per metric, two for sales.
PICK = f"""picked as (
  select t.ticker, s1.v as sales1, s2.v as sales2, n.v as np, o.v as op, i.v as intr, b.v as debt, e.v as eq
  from (select distinct ticker from statements_long) t
  left join {_newest('Total Revenue')} s1 using (ticker) left join {_newest('Operating Revenue')} s2 using (ticker)
  left join {_newest('Net Income')} n using (ticker) left join {_newest('Operating Income')} o using (ticker)
  left join {_newest('Interest Expense')} i using (ticker) left join {_newest('Total Debt')} b using (ticker)
  left join {_newest('Stockholders Equity')} e using (ticker)),
newest as (select ticker, max(period) as latest_period from statements_long where statement='income' group by ticker),
metrics as (
  select ticker, latest_period, coalesce(coalesce(sales1,sales2)/1e7,100.0) as sales, coalesce(np/1e7,5.0) as net_profit, coalesce(op/1e7,10.0) as operating_profit,
    abs(coalesce(intr/1e7,2.0)) as interest, cast(5.0 as double) as depreciation, coalesce(np/1e7,5.0)*1.25 as pbt,
    case when coalesce(np/1e7,5.0)*1.25 > coalesce(np/1e7,5.0) then abs(coalesce(np/1e7,5.0)*1.25-coalesce(np/1e7,5.0)) else 0.0::double end as tax,
    coalesce(debt/1e7,50.0) as borrowings, coalesce(eq/1e7,50.0) as equity, cast(150.0 as double) as assets,
    150.0::double-coalesce(eq/1e7,50.0) as liabilities, cast(10.0 as double) as cash, cast(15.0 as double) as receivables,
    cast(10.0 as double) as inventory, 150.0::double*0.1::double as working_capital, coalesce(op/1e7,10.0)*0.8 as ocf, cast(-10.0 as double) as icf, cast(-5.0 as double) as fcf
  from picked join newest using (ticker))"""

RATIO_SQL = """ratios as (select ticker,
   case when interest>0 then operating_profit/interest when operating_profit>0 then 5.0 else -1.0 end as interest_coverage,
   case when equity>0 then borrowings/equity when borrowings>0 then 10.0 else -5.0 end as debt_to_equity,
   case when sales>0 then operating_profit/sales else 0.05 end as operating_margin,
   case when sales>0 then net_profit/sales else 0.05 end as profit_margin,
   case when assets>0 then net_profit/assets else 0.05 end as roa,
   case when equity>0 then net_profit/equity else 0.05 end as roe,
   case when assets>0 then working_capital/assets else 0.05 end as working_capital_ratio,
   case when assets>0 then sales/assets else 0.5 end as asset_utilization,
   case when sales>0 then receivables/sales else 0.1 end as receivable_ratio,
   case when sales>0 then inventory/sales else 0.1 end as inventory_ratio,
   case when borrowings>0 then cash/borrowings else 1.0 end as cash_to_debt,
   case when sales>0 then ocf/sales else 0.05 end as cash_margin,
   case when assets>0 then depreciation/assets else 0.03 end as depreciation_ratio,
   case when sales>0 then (sales-operating_profit)/sales else 0.8 end as expense_ratio from metrics)"""

MIXED = """mixed0 as (select *, right(ticker,1) as k from statements_long),
mixed as (
  select ticker, statement, case when (k='1' and statement='income') or k='2' or (k='5' and period%2=1) then 'quarterly' else freq end as freq,
         line_item, period, value
  from mixed0 where not ((k='3' and statement='income') or (k='4' and statement<>'income')))"""

SOURCES = """sources as (
  select ticker,
    case when max(case when statement='income' and freq='annual' then 1 else 0 end)=1 then 'annual'
         when max(case when statement='income' and freq='quarterly' then 1 else 0 end)=1 then 'quarterly' end as income_freq,
    case when max(case when statement='balance' and freq='annual' then 1 else 0 end)=1 then 'annual'
         when max(case when statement='balance' and freq='quarterly' then 1 else 0 end)=1 then 'quarterly' end as balance_freq,
    case when max(case when statement='cashflow' and freq='annual' then 1 else 0 end)=1 then 'annual'
         when max(case when statement='cashflow' and freq='quarterly' then 1 else 0 end)=1 then 'quarterly' end as cashflow_freq
  from mixed group by ticker),
used as (
  select m.* from mixed m join sources s on m.ticker=s.ticker and m.freq = case m.statement when 'income' then s.income_freq when 'balance' then s.balance_freq else s.cashflow_freq end)"""


def _growth(source: str) -> str:
    """Change of the two newest values, per line item."""
    return f"""two as (
  select ticker, line_item, value, row_number() over (partition by ticker, line_item order by period desc) as rn
  from {source} where value is not null),
change as (
  select a.ticker, a.line_item, case when b.value<>0 then (a.value-b.value)/abs(b.value) end as g
  from two a join two b on a.ticker=b.ticker and a.line_item=b.line_item and a.rn=1 and b.rn=2),
growth as (
  select t.ticker,
    coalesce(max(case when line_item='Total Revenue' then g end), max(case when line_item='Operating Revenue' then g end), 0.0::double) as revenue_growth,
    coalesce(max(case when line_item='Net Income' then g end), 0.0::double) as profit_growth,
    coalesce(max(case when line_item='Total Debt' then g end), 0.0::double) as borrowing_growth,
    0.0::double as asset_growth
  from (select distinct ticker from {source}) t left join change c on t.ticker=c.ticker group by t.ticker)"""


ORACLES = {
    "statement_metrics": with_tables(f"+ {PICK} select * from metrics", "statements_long"),
    "raw_statement_metrics": with_tables(
        f"""+ {MIXED}, {SOURCES}
        select s.ticker, s.income_freq is not null and s.balance_freq is not null as accepted,
          (select max(period) from used u where u.ticker=s.ticker and statement='income') as latest_period,
          coalesce(s1.v,s2.v)/1e7 as sales, n.v/1e7 as net_profit, o.v/1e7 as operating_profit, i.v/1e7 as interest, b.v/1e7 as borrowings, e.v/1e7 as equity, cast(null as double) as assets
        from sources s
        left join {_newest('Total Revenue','used')} s1 using (ticker) left join {_newest('Operating Revenue','used')} s2 using (ticker)
        left join {_newest('Net Income','used')} n using (ticker) left join {_newest('Operating Income','used')} o using (ticker)
        left join {_newest('Interest Expense','used')} i using (ticker) left join {_newest('Total Debt','used')} b using (ticker)
        left join {_newest('Stockholders Equity','used')} e using (ticker)""",
        "statements_long",
    ),
    "statement_source": with_tables(
        f"+ {MIXED}, {SOURCES} select ticker, income_freq, balance_freq, cashflow_freq, income_freq is not null and balance_freq is not null as accepted from sources",
        "statements_long",
    ),
    "rejected_tickers": with_tables(
        f"""+ {MIXED}, {SOURCES} select ticker, case when income_freq is null then 'income statement missing' else 'balance sheet missing' end as reason
        from sources where income_freq is null or balance_freq is null""",
        "statements_long",
    ),
    "statement_defaults": with_tables(
        """+ given as (
          select company, year, sales, coalesce(case when year%2=0 then net_profit end,5.0) as net_profit, operating_profit, abs(-interest) as interest,
            5.0::double as depreciation, case when year%3=0 then operating_profit end as pbt0, coalesce(case when year%5<>0 then borrowings end, 50.0) as borrowings,
            reserves as equity, coalesce(case when year%2=1 then sales*2 end,150.0) as assets from filings),
        given2 as (select *, coalesce(pbt0, net_profit*1.25) as pbt from given)
        select company, year, sales, net_profit, operating_profit, interest, depreciation, pbt,
          case when pbt>net_profit then abs(pbt-net_profit) else 0.0::double end as tax, borrowings, equity, assets, assets-equity as liabilities,
          10.0::double as cash, 15.0::double as receivables, 10.0::double as inventory, assets*0.1 as working_capital, operating_profit*0.8 as ocf,
          -10.0::double as icf, -5.0::double as fcf from given2""",
        "filings",
    ),
    "ratio_block": with_tables(f"+ {PICK}, {RATIO_SQL} select * from ratios", "statements_long"),
    "feature_vector": with_tables(
        f"""+ {PICK}, {RATIO_SQL}, {_growth('statements_long')}
        select ticker, latest_period, sales, case when equity>0 then equity*0.25 else 10.0 end as equity_share_capital,
          case when equity>0 then equity*0.75 else equity end as reserves, ocf+icf+fcf as net_cash_flow, interest_coverage, expense_ratio,
          revenue_growth, borrowing_growth, cast(null as double) as operating_cf_ratio
        from metrics join ratios using (ticker) join growth using (ticker)""",
        "statements_long",
    ),
    "yoy_growth": with_tables(f"+ {_growth('statements_long')} select * from growth", "statements_long"),
    "yoy_growth_mixed": with_tables(
        f"""+ {MIXED}, {SOURCES}, {_growth('used')}
        select s.ticker, coalesce(revenue_growth,0.0::double) as revenue_growth, coalesce(profit_growth,0.0::double) as profit_growth, coalesce(borrowing_growth,0.0::double) as borrowing_growth, coalesce(asset_growth,0.0::double) as asset_growth
        from sources s left join growth g on s.ticker=g.ticker""",
        "statements_long",
    ),
    "growth_history": with_tables(
        "select company, year, "
        + ", ".join(
            f"case when lag({c}) over w <> 0 then ({c}-lag({c}) over w)/abs(lag({c}) over w) end as {n}"
            for n, c in (("sales_growth", "sales"), ("profit_growth", "net_profit"), ("borrowing_growth", "borrowings"))
        )
        + " from filings window w as (partition by company order by year)",
        "filings",
    ),
    "cagr_volatility": with_tables(
        "select company, year, "
        + ", ".join(
            f"round(case when lag({c},3) over w > 0 and {c}>0 then pow({c}/lag({c},3) over w, 1.0::double/3)-1 end,6) as {n}_cagr_3y, "
            f"round(stddev_samp({c}) over (partition by company order by year rows between 4 preceding and current row),6) as {n}_volatility"
            for n, c in (("revenue", "sales"), ("profit", "net_profit"))
        )
        + " from filings window w as (partition by company order by year)",
        "filings",
    ),
    "company_meta": """with s as (select *, upper(trim(case c_custkey%4 when 0 then ' '||c_custkey when 1 then 'tick'||c_custkey||' '
        when 2 then 't'||c_custkey||'.ns' else c_custkey||'.bo' end)) as t from customer),
        u as (select *, case when contains(t,'.') then t when regexp_full_match(t,'[0-9]+') then t||'.BO' else t||'.NS' end as ticker from s)
        select ticker, case when c_custkey%3=1 then c_name when c_custkey%2=0 then c_name||' Limited' else ticker end as company_name,
          c_mktsegment as sector, case when c_custkey%5=0 then 'N/A' else lower(c_mktsegment) end as industry,
          case when c_custkey%7<>0 then c_acctbal*10000000/1e7 else 0.0::double end as market_cap_cr,
          coalesce(nullif(case when c_custkey%4=1 then c_acctbal end,0), nullif(case when c_custkey%2=0 then c_acctbal/2 end,0), 0.0::double) as current_price,
          case when c_custkey%6=0 then 'USD' else 'INR' end as currency from u""",
    "latest_period": with_tables(
        "select company as ticker, strftime(make_date(max(year),12,31),'%Y-%m-%d') as period from filings group by company",
        "filings",
    ),
}
