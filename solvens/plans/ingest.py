"""Reading, cleaning, labelling and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



from solvens.functions.text import class_name, normalize_ticker
from solvens.operators import cleaning, features, labels, lookup, preprocessing
from solvens.plans.base import with_tables
from solvens.session import scratch_path
from solvens.sources import readers, tables
from solvens.sources.tables import FILING_FEATURES

RATIOS = ["x1", "x2", "x3"]


def _raw(spark, d) -> DataFrame:
    return tables.raw_filings(spark, d)


def _clean(spark, d) -> DataFrame:
    out = cleaning.clean_filings(_raw(spark, d), RATIOS)
    return out.select("Company", "Year", "Standard_Label", "Target", *RATIOS).toDF(
        "company", "year", "standard_label", "target", *RATIOS
    )


def scan_filings(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "filings-csv")
    readers.write_table(_raw(spark, d), path, "csv")
    return readers.read_filings(spark, path)


def scan_statements(spark, d):
    path = scratch_path(spark, "statements")
    landed = tables.statements_long(spark, d).withColumn("period", F.make_date("period", F.lit(12), F.lit(31)))
    readers.write_table(landed, path)
    return readers.read_statements(spark, path)


def normalize_header(spark, d):
    raw = _raw(spark, d)
    return readers.normalize_header(raw.toDF(*[f" {c} " for c in raw.columns]))


def label_map_json(spark, d):
    """Codes through the stored mapping document, written and read back."""
    path = scratch_path(spark, "mapping")
    readers.write_json_document(spark, readers.label_mapping(), path)
    mapping = readers.read_json_document(spark, path, readers.LABEL_MAPPING_SCHEMA).select("numeric_to_string")
    # One document, so the broadcast side is one row.
    rows = tables.labelled(spark, d).groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    doc = mapping.select(F.explode("numeric_to_string").alias("code", "class_name"))
    return rows.join(F.broadcast(doc), rows.target.cast("string") == doc.code).select("target", "class_name", "n")


def json_features(spark, d):
    raw = _raw(spark, d)
    docs = raw.select("folder_name", "feature_name", F.to_json(F.struct("x1", "x2", "x3")).alias("doc"))
    return readers.read_feature_documents(docs, "doc", ["x1", "x2", "x3", "x4"], ["folder_name", "feature_name"])


def label_standardize(spark, d):
    return cleaning.standardize_labels(_raw(spark, d)).select(
        "folder_name", "feature_name", F.col("Standard_Label").alias("standard_label")
    )


def label_filter(spark, d):
    return cleaning.unlabelled_count(cleaning.standardize_labels(_raw(spark, d)))


def label_encode(spark, d):
    coded = cleaning.encode_target(cleaning.standardize_labels(_raw(spark, d)))
    return coded.groupBy(F.col("Standard_Label").alias("standard_label"), F.col("Target").alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("name_again", class_name("code"))


def derive_ids(spark, d):
    return cleaning.derive_ids(_raw(spark, d)).select(F.col("Company").alias("company"), F.col("Year").alias("year"))


def coerce_numeric(spark, d):
    return cleaning.coerce_numeric(_raw(spark, d), RATIOS).select("folder_name", "feature_name", *RATIOS)


def align_features(spark, d):
    return cleaning.align_features(_raw(spark, d), ["x3", "x1", "x9"], ["folder_name", "feature_name"])


def union_sources(spark, d):
    raw = _raw(spark, d)
    even = F.col("feature_name").cast("int") % 2 == 0
    return cleaning.union_sources(raw.filter(even).drop("x3"), raw.filter(~even))


def clean_filings(spark, d):
    return _clean(spark, d)


def _with_copies(spark, d):
    clean = _clean(spark, d)
    again = clean.filter(F.col("year").cast("int") % 3 == 0)
    return clean.withColumn("source", F.lit(1)).unionByName(again.withColumn("source", F.lit(2)))


def dup_count(spark, d):
    return cleaning.duplicate_count(_with_copies(spark, d), [*RATIOS, "standard_label"])


def key_dup_rows(spark, d):
    return cleaning.key_duplicate_rows(_with_copies(spark, d), ["company", "year"])


def dedup_keep_first(spark, d):
    return cleaning.drop_duplicates_keep_first(
        _with_copies(spark, d), ["company", "year", "target", *RATIOS], ["source", "standard_label"]
    )


def stage_counts(spark, d):
    """Every filing counted at each stage: as delivered, with a label, with its copies (two of every third year), and without them."""
    raw = _raw(spark, d)
    standard = cleaning.standardize_labels(raw)
    known = F.col("Standard_Label").isNotNull()
    rows = cleaning.coerce_numeric(cleaning.derive_ids(cleaning.encode_target(standard), "folder_name", "feature_name"), RATIOS)
    copies = F.when(F.col("Year").cast("int") % 3 == 0, 2).otherwise(1)
    stages = {
        "raw": (F.lit(1), len(raw.columns)),
        "labelled": (known.cast("int"), len(standard.columns)),
        "with_copies": (F.when(known, copies).otherwise(0), 8),
    }
    return cleaning.stage_counts(rows, stages, {"deduplicated": ("with_copies", ["Company", "Year", "Target", *RATIOS], 8)})


def missing_report(spark, d):
    return cleaning.missing_report(_clean(spark, d), RATIOS)


def inf_report(spark, d):
    raw = _raw(spark, d)
    spoiled = raw.withColumn("x1", F.when(F.col("x1") == "NA", F.lit("-inf")).otherwise(F.col("x1")))
    return cleaning.infinity_report(cleaning.coerce_numeric(spoiled, RATIOS), RATIOS)


def class_distribution(spark, d):
    return cleaning.class_distribution(tables.labelled(spark, d))


def raw_class_distribution(spark, d):
    standard = cleaning.standardize_labels(_raw(spark, d)).withColumnRenamed("Standard_Label", "standard_label")
    return cleaning.class_distribution(standard, "standard_label")


def net_worth(spark, d):
    return tables.filings(spark, d).select(
        "company", "year", labels.net_worth("equity_share_capital", "reserves").alias("net_worth")
    )


def rule_label(spark, d):
    return tables.labelled(spark, d).select("company", "year", "target")


def label_override(spark, d):
    names = tables.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    listed = names.select(F.concat(F.lit("  "), F.upper("c_name")).alias("name"))
    return labels.override_labels(tables.labelled(spark, d), listed).select("company", "year", "target")


def binary_target(spark, d):
    df = tables.labelled(spark, d).withColumn("healthy", labels.binary_target())
    distressed = (F.col("target") != labels.HEALTHY).cast("int")
    return df.groupBy("target", "healthy").agg(F.count(F.lit(1)).alias("n"), F.sum(distressed).alias("distressed"))


def distressed_rows(spark, d):
    return labels.distressed_only(tables.labelled(spark, d)).select("company", "year", "target")


def label_lookup_join(spark, d):
    dim = labels.class_names_dim(spark)
    rows = tables.labelled(spark, d).select("company", "year", "target")
    return rows.join(F.broadcast(dim), rows.target == dim.code, "left").select("company", "year", "target", "name")


def row_counts(spark, d):
    return features.row_counts(tables.filings(spark, d), FILING_FEATURES).select(
        "company", "year", "num_negative", "num_zero"
    )


def row_stats(spark, d):
    df = features.row_statistics(tables.filings(spark, d).na.fill(0.0), FILING_FEATURES)
    stats = ["mean_ratio", "std_ratio", "median_ratio"]
    return df.select("company", "year", *[F.round(c, 9).alias(c) for c in stats])


def interactions(spark, d):
    df = tables.filings(spark, d)
    out = features.interactions(
        df,
        {"profit_div_interest": ("operating_profit", "interest"), "debt_div_reserves": ("borrowings", "reserves")},
        {"margin_mul_sales": ("operating_margin", "sales")},
    )
    return out.select("company", "year", "profit_div_interest", "debt_div_reserves", "margin_mul_sales")


def median_impute(spark, d):
    clean = _clean(spark, d)
    imputer = preprocessing.MedianImputer(RATIOS).fit(clean)
    return imputer.transform(clean).select("company", "year", "target", *RATIOS)


def standard_scale(spark, d):
    df = tables.filings(spark, d)
    columns = ["sales", "interest", "net_profit", "equity_share_capital"]
    scaled = preprocessing.StandardScaler(columns).fit(df).transform(df)
    return scaled.select("company", "year", *[F.round(c, 6).alias(c) for c in columns])


def corr_pairs(spark, d):
    columns = ["sales", "operating_profit", "interest", "net_profit", "reserves", "equity_share_capital"]
    return preprocessing.correlation_pairs(tables.filings(spark, d), columns)


def scenario_filter(spark, d):
    rules = lookup.demo_scenarios()
    found = lookup.scenario_filter(tables.filings(spark, d), rules, ["company", "year"])
    return found.select("scenario", "company", "year", "net_profit", "interest_coverage")


def company_search(spark, d):
    df = tables.filings(spark, d).withColumn("position", F.struct("year", "company"))
    found = lookup.company_search(df, "CUSTOMER#0+1[0-9]*7$", "position")
    return found.select("company", F.col("first_position.year").alias("first_year"))


def company_list(spark, d):
    return lookup.company_list(tables.filings(spark, d))


def company_history(spark, d):
    df = tables.labelled(spark, d)
    return lookup.company_history(df, "Customer#000000007").select("company", "year", "sales", "target")


def latest_filing(spark, d):
    return lookup.latest_filing(tables.labelled(spark, d)).select("company", "year", "sales", "net_profit", "target")


def sample_per_class(spark, d):
    return lookup.first_per_class(tables.labelled(spark, d), "target", ["company", "year"]).select(
        "target", "company", "year", "sales"
    )


def random_per_class(spark, d):
    return lookup.random_per_class(tables.labelled(spark, d), "target", ["company", "year"]).select(
        "target", "company", "year"
    )


def seeded_sample(spark, d):
    return lookup.seeded_sample(tables.filings(spark, d), 500, ["company", "year"]).select("company", "year", "sales")


def scenario_table(spark, d):
    given = tables.filings(spark, d).withColumn("equity", F.col("equity_share_capital") + F.col("reserves"))
    wanted = ["Sales", "Equity Share Capital", "Reserves", "Interest_Coverage", "ROA"]
    out = lookup.scenario_vectors(given, ["company", "year"], wanted)
    return out.toDF("company", "year", "sales", "equity_share_capital", "reserves", "interest_coverage", "roa")


def string_basics(spark, d):
    c = tables.table(spark, d, "customer")
    name = F.col("c_name")
    return c.select(
        "c_custkey",
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.lower(name).alias("lowered"),
        F.upper(F.col("c_mktsegment")).alias("uppered"),
        F.replace(name, F.lit("#"), F.lit(" ")).alias("replaced"),
        F.contains(name, F.lit("0001")).alias("has_0001"),
        F.startswith(name, F.lit("Customer")).alias("is_customer"),
        F.split_part(name, F.lit("#"), F.lit(1)).alias("head"),
    )


def ticker_symbols(spark, d) -> DataFrame:
    """Customer keys spelled as symbols in several ways."""
    c = tables.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    symbol = (
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit(" "), key))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("tick"), key, F.lit(" ")))
        .when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("t"), key, F.lit(".ns")))
        .otherwise(F.concat(key, F.lit(".bo")))
    )
    return c.select("c_custkey", symbol.alias("symbol"))


def ticker(spark, d):
    return ticker_symbols(spark, d).select("c_custkey", normalize_ticker("symbol").alias("ticker"))



CLASS_SQL = "case {c} when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' when 3 then 'Healthy' end"
NUM = "try_cast(trim(replace({c},'\"','')) as double)"
COPIES = """+ copies as (
  select *, 1 as source from clean union all select *, 2 as source from clean where cast(year as integer) % 3 = 0)
"""
FILLED = ", ".join(f"coalesce({c},0)" for c in FILING_FEATURES)

QUERIES = {
    "scan_filings": scan_filings,
    "scan_statements": scan_statements,
    "normalize_header": normalize_header,
    "label_map_json": label_map_json,
    "json_features": json_features,
    "label_standardize": label_standardize,
    "label_filter": label_filter,
    "label_encode": label_encode,
    "derive_ids": derive_ids,
    "coerce_numeric": coerce_numeric,
    "align_features": align_features,
    "union_sources": union_sources,
    "clean_filings": clean_filings,
    "dup_count": dup_count,
    "key_dup_rows": key_dup_rows,
    "dedup_keep_first": dedup_keep_first,
    "stage_counts": stage_counts,
    "missing_report": missing_report,
    "inf_report": inf_report,
    "class_distribution": class_distribution,
    "raw_class_distribution": raw_class_distribution,
    "net_worth": net_worth,
    "rule_label": rule_label,
    "label_override": label_override,
    "binary_target": binary_target,
    "distressed_rows": distressed_rows,
    "label_lookup_join": label_lookup_join,
    "row_counts": row_counts,
    "row_stats": row_stats,
    "interactions": interactions,
    "median_impute": median_impute,
    "standard_scale": standard_scale,
    "corr_pairs": corr_pairs,
    "scenario_filter": scenario_filter,
    "company_search": company_search,
    "company_list": company_list,
    "company_history": company_history,
    "latest_filing": latest_filing,
    "sample_per_class": sample_per_class,
    "random_per_class": random_per_class,
    "seeded_sample": seeded_sample,
    "scenario_table": scenario_table,
    "string_basics": string_basics,
    "normalize_ticker": ticker,
}

_CORR_COLS = ["sales", "operating_profit", "interest", "net_profit", "reserves"]
_corr = " union all ".join(
    f"select '{a}' as feature_1, '{b}' as feature_2, corr({a},{b}) as r from filings"
    for i, a in enumerate(_CORR_COLS)
    for b in _CORR_COLS[i + 1 :]
)

ORACLES = {
    # An empty CSV field is a missing value.
    "scan_filings": with_tables("select * replace (nullif(x2,'') as x2) from raw_filings", "raw_filings"),
    "scan_statements": with_tables(
        "select ticker, statement, freq, line_item, make_date(period,12,31) as period, value from statements_long",
        "statements_long",
    ),
    "normalize_header": with_tables("select * from raw_filings", "raw_filings"),
    "label_map_json": with_tables(
        f"select target, {CLASS_SQL.format(c='target')} as class_name, count(*) as n from labelled group by target",
        "labelled",
    ),
    "json_features": with_tables(
        f"select folder_name, feature_name, {NUM.format(c='x1')} as x1, {NUM.format(c='x2')} as x2, {NUM.format(c='x3')} as x3, cast(null as double) as x4 from raw_filings",
        "raw_filings",
    ),
    "label_standardize": with_tables("select folder_name, feature_name, standard_label from standard", "clean"),
    "label_filter": with_tables(
        "select count(*) as rows, count(*) filter (where standard_label is null) as unlabelled, count(standard_label) as labelled from standard",
        "clean",
    ),
    "label_encode": with_tables(
        """select standard_label, case standard_label when 'Bankrupt' then 0 when 'Financial Distress' then 1
           when 'Probably Bankrupt' then 2 when 'Healthy' then 3 end as code, count(*) as n, standard_label as name_again
           from standard group by standard_label""",
        "clean",
    ),
    "derive_ids": with_tables("select trim(folder_name) as company, trim(feature_name) as year from raw_filings", "raw_filings"),
    "coerce_numeric": with_tables(
        f"select folder_name, feature_name, {NUM.format(c='x1')} as x1, {NUM.format(c='x2')} as x2, {NUM.format(c='x3')} as x3 from raw_filings",
        "raw_filings",
    ),
    "align_features": with_tables(
        f"select folder_name, feature_name, {NUM.format(c='x3')} as x3, {NUM.format(c='x1')} as x1, cast(null as double) as x9 from raw_filings",
        "raw_filings",
    ),
    "union_sources": with_tables(
        """select folder_name, feature_name, label, x1, x2, case when cast(feature_name as integer) % 2 = 0 then null else x3 end as x3
           from raw_filings""",
        "raw_filings",
    ),
    "clean_filings": with_tables("select * from clean", "clean"),
    "dup_count": with_tables(
        COPIES + "select cast(sum(n-1) as bigint) as duplicates from (select count(*) as n from copies group by x1,x2,x3,standard_label)",
        "clean",
    ),
    "key_dup_rows": with_tables(
        COPIES + "select cast(sum(n) as bigint) as rows_involved from (select count(*) as n from copies group by company, year having count(*)>1)",
        "clean",
    ),
    "dedup_keep_first": with_tables(
        COPIES
        + """select company, year, standard_label, target, x1, x2, x3, source from (
             select *, row_number() over (partition by company, year, target, x1, x2, x3 order by source, standard_label) as rn from copies) where rn=1""",
        "clean",
    ),
    "stage_counts": with_tables(
        COPIES
        + """select 'raw' as stage, count(*) as rows, 6 as columns from raw_filings
           union all select 'labelled', count(*), 7 from standard where standard_label is not null
           union all select 'with_copies', count(*), 8 from copies
           union all select 'deduplicated', count(*), 8 from (select distinct company, year, target, x1, x2, x3 from copies)""",
        "clean",
    ),
    "missing_report": with_tables(
        " union all ".join(
            f"select '{c}' as feature, count(*) filter (where {c} is null) as missing_count, round(count(*) filter (where {c} is null)/count(*)*100, 2) as missing_pct from clean"
            for c in RATIOS
        ),
        "clean",
    ),
    "inf_report": with_tables(
        "select 'x1' as feature, count(*) as inf_count from raw_filings where x1 = 'NA' having count(*) > 0", "raw_filings"
    ),
    "class_distribution": with_tables(
        "select target, count(*) as n, round(count(*)/sum(count(*)) over ()*100, 2) as pct from labelled group by target",
        "labelled",
    ),
    "raw_class_distribution": with_tables(
        "select standard_label, count(*) as n, round(count(*)/sum(count(*)) over ()*100, 2) as pct from standard group by standard_label",
        "clean",
    ),
    "net_worth": with_tables("select company, year, equity_share_capital+reserves as net_worth from filings", "filings"),
    "rule_label": with_tables("select company, year, target from labelled", "labelled"),
    "label_override": with_tables(
        """select company, year, case when target=3 and lower(trim(company)) in
             (select lower(trim('  ' || upper(c_name))) from customer where c_mktsegment='BUILDING') then 1 else target end as target
           from labelled""",
        "labelled",
    ),
    "binary_target": with_tables(
        """select target, cast(target=3 as integer) as healthy, count(*) as n, cast(sum(case when target<>3 then 1 else 0 end) as bigint) as distressed
           from labelled group by target""",
        "labelled",
    ),
    "distressed_rows": with_tables("select company, year, target from labelled where target <> 3", "labelled"),
    "label_lookup_join": with_tables(
        f"select company, year, target, {CLASS_SQL.format(c='target')} as name from labelled", "labelled"
    ),
    "row_counts": with_tables(
        "select company, year, "
        + "+".join(f"coalesce(cast({c}<0 as integer),0)" for c in FILING_FEATURES)
        + " as num_negative, "
        + "+".join(f"coalesce(cast({c}=0 as integer),0)" for c in FILING_FEATURES)
        + " as num_zero from filings",
        "filings",
    ),
    "row_stats": with_tables(
        f"""select company, year, round(list_avg(v),9) as mean_ratio, round(list_stddev_samp(v),9) as std_ratio, round(list_median(v),9) as median_ratio
            from (select company, year, [{FILLED}] as v from filings)""",
        "filings",
    ),
    "interactions": with_tables(
        """select company, year, operating_profit/(abs(interest)+1e-4) as profit_div_interest,
           borrowings/(abs(reserves)+1e-4) as debt_div_reserves, operating_margin*sales as margin_mul_sales from filings""",
        "filings",
    ),
    "median_impute": with_tables(
        "select company, year, target, "
        + ", ".join(f"coalesce({c}, (select median({c}) from clean)) as {c}" for c in RATIOS)
        + " from clean",
        "clean",
    ),
    "standard_scale": with_tables(
        "select company, year, "
        + ", ".join(
            f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (),0),1),6) as {c}"
            for c in ("sales", "interest", "net_profit", "equity_share_capital")
        )
        + " from filings",
        "filings",
    ),
    "corr_pairs": with_tables(
        f"select feature_1, feature_2, round(r,4) as correlation, round(abs(r),4) as abs_correlation from ({_corr}) where abs(r)>=0.95",
        "filings",
    ),
    "scenario_filter": with_tables(
        " union all ".join(
            f"select * from (select '{n}' as scenario, company, year, net_profit, interest_coverage from filings where {w} order by company, year limit 1)"
            for n, w in (
                ("Bankrupt", "net_profit < -1000 and debt_to_equity > 5.0"),
                ("Financial Distress", "interest_coverage < 2.0 and interest_coverage > 1.0"),
                ("Probably Bankrupt", "interest_coverage < 1.0 and interest_coverage > 0"),
                ("Healthy", "interest_coverage > 10.0 and net_profit > 500"),
            )
        ),
        "filings",
    ),
    "company_search": with_tables(
        """select company, min(year) as first_year from filings where regexp_matches(company, '(?i)CUSTOMER#0+1[0-9]*7$')
           group by company order by first_year, company limit 10""",
        "filings",
    ),
    "company_list": with_tables("select distinct company from filings", "filings"),
    "company_history": with_tables(
        "select company, year, sales, target from labelled where company='Customer#000000007'", "labelled"
    ),
    "latest_filing": with_tables(
        "select company, year, sales, net_profit, target from labelled qualify row_number() over (partition by company order by year desc)=1",
        "labelled",
    ),
    "sample_per_class": with_tables(
        "select target, company, year, sales from labelled qualify row_number() over (partition by target order by company, year)=1",
        "labelled",
    ),
    "random_per_class": with_tables(
        "select target, company, year from labelled qualify row_number() over (partition by target order by md5(company||'|'||year||'|42'))=1",
        "labelled",
    ),
    "seeded_sample": with_tables(
        "select company, year, sales from filings order by md5(company||'|'||year||'|42') limit 500", "filings"
    ),
    "scenario_table": with_tables(
        """select company, year, sales, (equity_share_capital+reserves)*0.25 as equity_share_capital,
           (equity_share_capital+reserves)*0.75 as reserves, interest_coverage, cast(null as double) as roa from filings""",
        "filings",
    ),
    "string_basics": """select c_custkey, trim('  '||c_name||' ') as trimmed, lower(c_name) as lowered, upper(c_mktsegment) as uppered,
        replace(c_name,'#',' ') as replaced, contains(c_name,'0001') as has_0001, starts_with(c_name,'Customer') as is_customer,
        split_part(c_name,'#',1) as head from customer""",
    "normalize_ticker": """with s as (select c_custkey, upper(trim(case c_custkey%4 when 0 then ' '||c_custkey when 1 then 'tick'||c_custkey||' '
        when 2 then 't'||c_custkey||'.ns' else c_custkey||'.bo' end)) as t from customer)
        select c_custkey, case when contains(t,'.') then t when regexp_full_match(t,'[0-9]+') then t||'.BO' else t||'.NS' end as ticker from s""",
}
