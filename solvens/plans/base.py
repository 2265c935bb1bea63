"""SQL of the derived tables, shared by the checks."""

from __future__ import annotations

TABLES = {
    "filings": """
with_lines as (
  select l_orderkey,
         sum(cast(round(l_extendedprice*100) as bigint)) as gross_c,
         sum(cast(round(l_extendedprice*l_discount*100) as bigint)) as disc_c,
         sum(case when l_returnflag='R' then cast(round(l_extendedprice*100) as bigint) else 0 end) as ret_c
  from lineitem group by l_orderkey),
with_orders as (
  select c_name, c_acctbal, year(o_orderdate) as yr,
         sum(gross_c) as sales_c, sum(disc_c) as disc_c, sum(ret_c) as ret_c,
         sum(case when o_orderstatus='P' then cast(round(o_totalprice*100) as bigint) else 0 end) as debt_c,
         sum(cast(round(o_totalprice*100) as bigint)) as tot_c
  from orders join customer on o_custkey=c_custkey join with_lines on l_orderkey=o_orderkey
  group by c_name, c_acctbal, year(o_orderdate)),
with_base as (
  select c_name as company, cast(yr as integer) as year,
         cast(sales_c as double)/100000 as sales,
         cast(sales_c*55 - ret_c*100 - disc_c*100 as double)/10000000 as operating_profit,
         cast(tot_c*2 as double)/10000000 as interest,
         cast(debt_c as double)/100000 as borrowings,
         cast(100.0 as double) as equity_share_capital,
         round(c_acctbal*10)/100 as reserves
  from with_orders),
filings as (
  select company, year, sales, operating_profit, interest, borrowings, equity_share_capital, reserves,
         operating_profit-interest as net_profit,
         case when interest>0 then operating_profit/interest end as interest_coverage,
         case when equity_share_capital+reserves<>0 then borrowings/(equity_share_capital+reserves) end as debt_to_equity,
         case when sales>0 then operating_profit/sales end as operating_margin
  from with_base)""",
    "labelled": """
labelled as (
  select *, case when equity_share_capital+reserves<0 or (interest_coverage < -1 and net_profit < -100) then 0
   when interest_coverage<1 or debt_to_equity>4 or (net_profit<0 and interest_coverage<1.5) then 2
   when interest_coverage<2.5 or debt_to_equity>2 or operating_margin<0.02 then 1 else 3 end as target
  from filings)""",
    "statements_long": """
statements_long as (
  select company as ticker, 'income' as statement, 'annual' as freq, 'Total Revenue' as line_item, year as period,
         case when year % 5 = 0 then null else sales*10000000 end as value from filings
  union all select company, 'income', 'annual', 'Operating Revenue', year, sales*9000000 from filings
  union all select company, 'income', 'annual', 'Net Income', year, net_profit*10000000 from filings
  union all select company, 'income', 'annual', 'Operating Income', year, operating_profit*10000000 from filings
  union all select company, 'income', 'annual', 'Interest Expense', year, -interest*10000000 from filings
  union all select company, 'balance', 'annual', 'Total Debt', year, borrowings*10000000 from filings
  union all select company, 'balance', 'annual', 'Stockholders Equity', year, (equity_share_capital+reserves)*10000000 from filings)""",
    "raw_filings": """
raw_filings as (
  select concat(' ',company,' ') as folder_name, cast(year as varchar) as feature_name,
   case target when 0 then 'Bankrupt' when 1 then ' FINANCIAL DISTRESS'
     when 2 then (case when year % 2=0 then 'Probable Bankrupt' else 'probably bankrupt ' end)
     else (case when year=1999 and sales<100 then null else 'Healthy' end) end as label,
   case when year % 7 = 0 then 'NA' else concat('"',cast(round(sales*100) as bigint),'"') end as x1,
   case when borrowings = 0 then '' else concat(' ',cast(round(borrowings*100) as bigint),' ') end as x2,
   cast(cast(round(net_profit*100) as bigint) as varchar) as x3
  from labelled)""",
    "clean": """
standard as (
  select *, case lower(trim(label)) when 'bankrupt' then 'Bankrupt' when 'probable bankrupt' then 'Probably Bankrupt'
     when 'probably bankrupt' then 'Probably Bankrupt' when 'financial distress' then 'Financial Distress'
     when 'healthy' then 'Healthy' end as standard_label
  from raw_filings),
clean as (
  select trim(folder_name) as company, trim(feature_name) as year, standard_label,
     case standard_label when 'Bankrupt' then 0 when 'Financial Distress' then 1 when 'Probably Bankrupt' then 2 when 'Healthy' then 3 end as target,
     try_cast(trim(replace(x1,'"','')) as double) as x1,
     try_cast(trim(replace(x2,'"','')) as double) as x2,
     try_cast(trim(replace(x3,'"','')) as double) as x3
  from standard where standard_label is not null)""",
    "probs": """
probs as (
  select company, year, target, r0/(r0+r1+r2+r3) as p0, r1/(r0+r1+r2+r3) as p1, r2/(r0+r1+r2+r3) as p2, r3/(r0+r1+r2+r3) as p3
  from (select company,year,target,1/(1+abs(coalesce(interest_coverage,0)-(-2))) as r0,
          1/(1+abs(coalesce(interest_coverage,0)-(1.75))) as r1, 1/(1+abs(coalesce(interest_coverage,0)-(0.5))) as r2,
          1/(1+abs(coalesce(interest_coverage,0)-(4))) as r3 from labelled) q),
scored as (
  select *, case when p0>=p1 and p0>=p2 and p0>=p3 then 0 when p1>=p2 and p1>=p3 then 1 when p2>=p3 then 2 else 3 end as pred from probs)""",
    "attributions": """
attributions as (
  select company, year, target, 'Interest_Coverage' as feature, 0.10*(coalesce(interest_coverage,0)-3) as phi, interest_coverage as actual from labelled
  union all select company, year, target, 'Debt_to_Equity', -0.20*(coalesce(debt_to_equity,0)-0.5), debt_to_equity from labelled
  union all select company, year, target, 'Operating_Margin', 2.0*(coalesce(operating_margin,0)-0.10), operating_margin from labelled
  union all select company, year, target, 'Net profit', 0.001*(net_profit-50), net_profit from labelled
  union all select company, year, target, 'Sales', 0.0005*(sales-300), sales from labelled)""",
}

NEEDS = {
    "filings": [],
    "labelled": ["filings"],
    "statements_long": ["filings"],
    "raw_filings": ["labelled"],
    "clean": ["raw_filings"],
    "probs": ["labelled"],
    "attributions": ["labelled"],
}


def with_tables(body: str, *names: str) -> str:
    """``body`` preceded by the definitions of the named tables and what they need.

    ``body`` may start with further definitions (``x as (...), y as (...) select``)
    after the marker ``+``.
    """
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = ",".join(TABLES[n] for n in order)
    body = body.strip()
    if body.startswith("+"):
        return f"with {ctes},\n{body[1:]}"
    return f"with {ctes}\n{body}"


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
