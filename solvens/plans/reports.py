"""Factors, sentences, indicators and the assembled risk report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions import wording
from solvens.functions.text import format_value, parse_value
from solvens.operators import reporting as rp
from solvens.plans.base import text_literal, with_tables
from solvens.schemas import CLASS_NAMES, ESSENTIAL_FEATURES, FEATURE_DISPLAY_NAMES
from solvens.sources import tables

KEYS = ["company", "year"]


def _attributions(spark, d) -> DataFrame:
    return tables.attributions(spark, d).withColumnRenamed("target", "pred")


def essential_filter(spark, d):
    return rp.essential_only(tables.attributions(spark, d)).select(*KEYS, "feature", "phi")


def friendly_names(spark, d):
    df = tables.attributions(spark, d)
    odd = F.when(F.col("year") % 2 == 0, F.col("feature")).otherwise(F.concat(F.lit("Net_"), "feature"))
    return df.withColumn("feature", odd).groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "name", rp.friendly_name("feature")
    )


def topk_attributions(spark, d):
    return rp.top_attributions(tables.attributions(spark, d), KEYS, 3).select(*KEYS, "feature", "phi", "rank")


def attribution_ranking(spark, d):
    return rp.item_ranking(tables.scored_filings(spark, d)).withColumn("mean_abs_phi", F.round("mean_abs_phi", 6))


def risk_factors(spark, d):
    return rp.risk_factors(_attributions(spark, d), KEYS).select(
        *KEYS, "side", "rank", "feature", "name", "actual_text", "impact", "phi_shown", "supports_health", "explanation"
    )


def concise_factors(spark, d):
    return rp.risk_factors(_attributions(spark, d), KEYS, concise=True).select(*KEYS, "side", "feature", "explanation")


def explanations(spark, d):
    df = tables.attributions(spark, d).withColumn("side", F.when(F.col("phi") > 0, "risk").otherwise("health"))
    return rp.explain(df).select(*KEYS, "feature", "explanation")


def format_values(spark, d):
    return tables.attributions(spark, d).select(*KEYS, "feature", format_value("feature", "actual").alias("text"))


def parse_values(spark, d):
    df = tables.attributions(spark, d)
    return df.select(*KEYS, "feature", F.round(parse_value(format_value("feature", "actual")), 9).alias("value"))


def _ratios(spark, d) -> DataFrame:
    """Six indicator columns per filing; year decides which of them is missing."""
    df = tables.labelled(spark, d)
    return df.select(
        *KEYS,
        "interest_coverage",
        "debt_to_equity",
        F.when(F.col("year") % 4 != 0, F.col("operating_margin")).alias("operating_margin"),
        (F.col("net_profit") / (F.col("sales") * 2)).alias("roa"),
        F.when(F.col("reserves") != 0, F.col("net_profit") / F.col("reserves") / 100).alias("roe"),
        ((F.col("reserves") - F.col("borrowings")) / F.col("sales")).alias("working_capital_ratio"),
    )


def health_snapshot(spark, d):
    return rp.health_snapshot(_ratios(spark, d), KEYS)


def health_snapshot_shown(spark, d):
    """Statuses of the displayed values, a missing one shown as zero."""
    out = rp.health_snapshot(_ratios(spark, d), KEYS, missing_as_zero=True, rounded=True)
    return out.select(*KEYS, "metric", "value", "status")


def _report(spark, d, concise=False) -> DataFrame:
    shown = ["sales", "net_profit", "borrowings", "interest_coverage", "debt_to_equity", "operating_margin"]
    rows = tables.scored_filings(spark, d).select(*KEYS, *shown, "probs", "items")
    subtitle = F.concat(F.lit("Audited filing of fiscal year "), F.col("year").cast("string"))
    return rp.risk_report(rows, KEYS, F.col("company"), subtitle, concise=concise)


def joined_report(spark, d):
    """The report when attributions arrive as their own long table."""
    rows = tables.scored_filings(spark, d).drop("items")
    rows = rp.with_items(rows, tables.attributions(spark, d).drop("target"), KEYS)
    report = rp.risk_report(rows, KEYS, F.col("company"), F.lit(""))
    return report.select(*KEYS, _joined("risk_factors", "impact").alias("risk_impacts"), _joined("health_factors", "explanation").alias("health_texts"))


def summaries(spark, d):
    return _report(spark, d).select(*KEYS, "summary")


def _joined(column: str, field: str):
    return F.coalesce(F.array_join(F.transform(column, lambda f: f[field]), "|"), F.lit(""))


def risk_report(spark, d):
    return _report(spark, d).select(
        *KEYS,
        "name",
        "subtitle",
        "prediction",
        "confidence",
        F.element_at("probabilities", "Healthy").alias("pct_healthy"),
        _joined("ratios", "text").alias("ratio_texts"),
        _joined("risk_factors", "name").alias("risk_names"),
        _joined("health_factors", "name").alias("health_names"),
        _joined("snapshot", "status").alias("statuses"),
        _joined("chart", "tone").alias("tones"),
    )


def report_json(spark, d):
    docs = rp.report_json(_report(spark, d), KEYS)
    value = lambda path: F.get_json_object("document", path)
    return docs.select(
        *KEYS,
        value("$.prediction").alias("prediction"),
        value("$.confidence").cast("double").alias("confidence"),
        value("$.risk_factors[0].feature").alias("first_risk"),
        value("$.health_factors[0].feature").alias("first_health"),
        value("$.snapshot[0].status").alias("coverage_status"),
    )


QUERIES = {
    "essential_filter": essential_filter,
    "friendly_names": friendly_names,
    "topk_attributions": topk_attributions,
    "attribution_ranking": attribution_ranking,
    "risk_factors": risk_factors,
    "concise_factors": concise_factors,
    "explanations": explanations,
    "format_value": format_values,
    "parse_value": parse_values,
    "health_snapshot": health_snapshot,
    "health_snapshot_shown": health_snapshot_shown,
    "summaries": summaries,
    "risk_report": risk_report,
    "report_json": report_json,
    "joined_report": joined_report,
}

# --- SQL ---------------------------------------------------------------------


def _format_sql(f: str, v: str) -> str:
    return f"""(case when {v} is null then 'N/A'
      when regexp_matches(lower({f}),'coverage|debt_to_equity|cash_to_debt') then format('{{:.2f}}x',{v})
      when regexp_matches(lower({f}),'margin|roa|roe|growth|ratio') then (case when abs({v})<10 then format('{{:.1f}}%',{v}*100) else format('{{:.2f}}',{v}) end)
      when regexp_matches(lower({f}),'sales|profit|borrowings|liabilities|assets|cash|reserves|cost|expense|tax|income') then '₹'||format('{{:,.1f}}',{v})||' Cr'
      else format('{{:.2f}}',{v}) end)"""


def _name_sql(f: str) -> str:
    whens = " ".join(f"when {text_literal(k)} then {text_literal(n)}" for k, n in FEATURE_DISPLAY_NAMES.items())
    return f"(case {f} {whens} else replace({f},'_',' ') end)"


def _template_sql(sentence: str, slots: dict[str, str]) -> str:
    out = text_literal(sentence)
    for key, sql in slots.items():
        out = out.replace("{" + key + "}", f"'||coalesce({sql},'N/A')||'")
    return out


def _explain_sql(rules: dict, other: list, f: str = "feature", v: str = "actual", side: str = "side") -> str:
    slots = {
        "x": f"format('{{:.2f}}x',{v})",
        "n": f"format('{{:.2f}}',{v})",
        "p": f"format('{{:.1f}}%',{v}*100)",
        "t": _format_sql(f, v),
        "name": _name_sql(f),
    }

    def branches(items):
        parts = []
        for test, on_side, sentence in items:
            cond = "true" if test is None else "(" + test.replace("v ", f"{v} ") + ")"
            if on_side:
                cond += f" and {side}='{on_side}'"
            parts.append(f"when {cond} then {_template_sql(sentence, slots)}")
        return "case " + " ".join(parts) + " end"

    return "case " + " ".join(f"when {f}={text_literal(k)} then ({branches(b)})" for k, b in rules.items()) + f" else ({branches(other)}) end"


DETAILED_SQL = _explain_sql(wording.DETAILED, wording.DETAILED_OTHER)
CONCISE_SQL = _explain_sql(wording.CONCISE, wording.CONCISE_OTHER)
ESSENTIAL_SQL = ", ".join(text_literal(f) for f in ESSENTIAL_FEATURES)

# Factor selection over a table a(company, year, pred, feature, phi, actual).
FACTORS = f"""signed as (
  select *, case when phi>=0.04 then 1 when phi<=-0.05 then -1 end as sgn from a where feature in ({ESSENTIAL_SQL})),
ranked as (select *, cast(row_number() over (partition by company, year, sgn order by abs(phi) desc, feature) as integer) as rank from signed where sgn is not null),
factors as (
  select company, year, pred, feature, phi, actual, rank, case when (sgn=1)=(pred=3) then 'health' else 'risk' end as side,
    case when sgn=1 and pred=3 then '+'||format('{{:.2f}}',phi)||' toward Healthy' when sgn=1 then '+'||format('{{:.2f}}',phi)
         when pred=3 then format('{{:.2f}}',phi) else '+'||format('{{:.2f}}',abs(phi))||' buffer' end as impact
  from ranked where rank <= case when sgn=1 then 4 when pred=3 then 3 else 2 end)"""

BY_TARGET = "a as (select company, year, target as pred, feature, phi, actual from attributions)"


def _status_sql(v: str, cuts) -> str:
    if cuts is None:
        return f"(case when {v}<0 or {v}>=10 then 'Critical' when {v}>3 then 'Concerning' when {v}>1.5 then 'Moderate' when {v} is not null then 'Strong' else 'Unknown' end)"
    whens = " ".join(f"when {v}>={c} then '{s}'" for s, c in zip(wording.STATUSES, cuts))
    return f"(case {whens} when {v} is not null then 'Critical' else 'Unknown' end)"


def _snapshot_sql(shown: bool) -> str:
    parts = []
    for name, c, kind, bench, cuts, good_from, good, bad in wording.INDICATORS:
        v = f"coalesce({c},0)" if shown else c
        text = {"x": f"format('{{:.2f}}x',{v})", "p": f"format('{{:.1f}}%',{v}*100)", "n": f"format('{{:.2f}}',{v})"}[kind]
        t = v
        if shown:
            t = f"(cast(format('{{:.1f}}',{v}*100) as double)/100)" if kind == "p" else f"cast(format('{{:.2f}}',{v}) as double)"
        status = _status_sql(t, cuts)
        if shown:
            parts.append(f"select company, year, {text_literal(name)} as metric, {text} as value, {status} as status from ratios")
            continue
        fine = f"{t}<=1.5 and {t}>0" if cuts is None else f"{t}>={good_from}"
        colour = f"(case {status} " + " ".join(f"when '{s}' then '{k}'" for s, k in wording.COLOURS.items()) + " end)"
        parts.append(
            f"select company, year, {text_literal(name)} as metric, coalesce({text},'N/A') as value, {text_literal(bench)} as benchmark, {status} as status, "
            f"{colour} as colour, case when {t} is null then 'Not reported' when {fine} then {text_literal(good)} else {text_literal(bad)} end as implication from ratios"
        )
    return " union all ".join(parts)


RATIOS = """ratios as (select company, year, interest_coverage, debt_to_equity, case when year%4<>0 then operating_margin end as operating_margin,
  net_profit/(sales*2) as roa, case when reserves<>0 then net_profit/reserves/100 end as roe, (reserves-borrowings)/sales as working_capital_ratio from labelled)"""


def _summary_sql() -> str:
    slots = {
        "conf": "format('{:.2f}',confidence)",
        "ic": "format('{:.2f}x',interest_coverage)",
        "de": "format('{:.2f}x',debt_to_equity)",
        "om": "format('{:.1f}%',operating_margin*100)",
    }
    whens = []
    for code, name in enumerate(CLASS_NAMES):
        sentence, side, fallback = wording.SUMMARIES[name]
        factors = f"coalesce(array_to_string(list_slice({side}_names,1,2),' and '),{text_literal(fallback)})"
        whens.append(f"when {code} then {_template_sql(sentence, {**slots, 'factors': factors})}")
    return "case pred " + " ".join(whens) + " end"


REPORT = f"""a as (select s.company, s.year, s.pred, feature, phi, actual from scored s join attributions using (company, year)), {FACTORS},
lists as (select company, year,
   list({_name_sql('feature')} order by rank) filter (where side='risk') as risk_names,
   list({_name_sql('feature')} order by rank) filter (where side='health') as health_names,
   list(feature order by rank) filter (where side='risk') as risk_ids,
   list(impact order by rank) filter (where side='risk') as risk_impacts,
   list({DETAILED_SQL} order by rank) filter (where side='health') as health_texts,
   list(feature order by rank) filter (where side='health') as health_ids,
   list(case when round(phi,4)>0 and pred=3 or round(phi,4)<0 and pred<>3 then 'good' else 'bad' end order by side, rank) as tones
   from factors group by company, year),
report as (select s.company, s.year, s.pred, case s.pred when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' else 'Healthy' end as prediction,
   cast(format('{{:.2f}}',greatest(p0,p1,p2,p3)*100) as double) as confidence, cast(format('{{:.2f}}',p3*100) as double) as pct_healthy,
   risk_names, health_names, risk_ids, health_ids, tones, risk_impacts, health_texts, f.sales, f.net_profit, f.borrowings, f.interest_coverage, f.debt_to_equity, f.operating_margin
   from scored s join labelled f using (company, year) left join lists using (company, year))"""

_ratio_texts = "||'|'||".join(
    _format_sql(text_literal(n), c) for n, c in rp.RATIO_LINES.items() if c not in ("roa", "roe", "working_capital_ratio")
)
_statuses = "||'|'||".join(
    "'Unknown'" if c in ("roa", "roe", "working_capital_ratio") else _status_sql(c, cuts)
    for _, c, _, _, cuts, *_ in wording.INDICATORS
)

ORACLES = {
    "essential_filter": with_tables(
        f"select company, year, feature, phi from attributions where feature in ({ESSENTIAL_SQL})", "attributions"
    ),
    "friendly_names": with_tables(
        f"""select feature, count(*) as n, {_name_sql('feature')} as name
        from (select case when year%2=0 then feature else 'Net_'||feature end as feature from attributions) group by feature""",
        "attributions",
    ),
    "topk_attributions": with_tables(
        """select company, year, feature, phi, rank from (select *, cast(row_number() over (partition by company, year order by abs(phi) desc, feature) as integer) as rank
        from attributions) where rank<=3""",
        "attributions",
    ),
    "attribution_ranking": with_tables(
        "select feature, round(avg(abs(phi)),6) as mean_abs_phi from attributions group by feature order by 2 desc limit 20", "attributions"
    ),
    "risk_factors": with_tables(
        f"""+ {BY_TARGET}, {FACTORS} select company, year, side, rank, feature, {_name_sql('feature')} as name, {_format_sql('feature','actual')} as actual_text, impact,
        cast(format('{{:.4f}}',phi) as double) as phi_shown, case when pred=3 then phi>0 else phi<0 end as supports_health, {DETAILED_SQL} as explanation from factors""",
        "attributions",
    ),
    "concise_factors": with_tables(
        f"+ {BY_TARGET}, {FACTORS} select company, year, side, feature, {CONCISE_SQL} as explanation from factors", "attributions"
    ),
    "explanations": with_tables(
        f"+ sided as (select *, case when phi>0 then 'risk' else 'health' end as side from attributions) select company, year, feature, {DETAILED_SQL} as explanation from sided",
        "attributions",
    ),
    "format_value": with_tables(f"select company, year, feature, {_format_sql('feature','actual')} as text from attributions", "attributions"),
    "parse_value": with_tables(
        f"""+ t as (select company, year, feature, {_format_sql('feature','actual')} as s from attributions),
        u as (select *, coalesce(try_cast(trim(regexp_replace(s,'₹|Cr|x|%|,','','g')) as double),0) as n from t)
        select company, year, feature, round(case when contains(s,'%') then n/100 else n end,9) as value from u""",
        "attributions",
    ),
    "health_snapshot": with_tables(f"+ {RATIOS} {_snapshot_sql(False)}", "labelled"),
    "health_snapshot_shown": with_tables(f"+ {RATIOS} {_snapshot_sql(True)}", "labelled"),
    "summaries": with_tables(f"+ {REPORT} select company, year, {_summary_sql()} as summary from report", "probs", "attributions"),
    "risk_report": with_tables(
        f"""+ {REPORT} select company, year, company as name, 'Audited filing of fiscal year '||year as subtitle, prediction, confidence, pct_healthy,
        {_ratio_texts} as ratio_texts, coalesce(array_to_string(risk_names,'|'),'') as risk_names, coalesce(array_to_string(health_names,'|'),'') as health_names,
        {_statuses} as statuses, coalesce(array_to_string(tones,'|'),'') as tones from report""",
        "probs",
        "attributions",
    ),
    "report_json": with_tables(
        f"""+ {REPORT} select company, year, prediction, confidence, risk_ids[1] as first_risk, health_ids[1] as first_health,
        {_status_sql('interest_coverage', wording.INDICATORS[0][4])} as coverage_status from report""",
        "probs",
        "attributions",
    ),
    "joined_report": with_tables(
        f"+ {REPORT} select company, year, coalesce(array_to_string(risk_impacts,'|'),'') as risk_impacts, coalesce(array_to_string(health_texts,'|'),'') as health_texts from report",
        "probs",
        "attributions",
    ),
}
