"""Operators on hand-made rows: boundaries, missing values, skewed groups, golden averages."""

import pytest
from pyspark.sql import functions as F

from solvens.functions.wording import INDICATORS
from solvens.operators import cleaning, labels, lookup, metrics, preprocessing, reporting, splitting
from solvens.operators import statements as st
from solvens.schemas import AUDITED_FEATURES, name_map

NAN = float("nan")


@pytest.mark.parametrize(
    "nw, ic, np_, de, om, want",
    [
        (-0.01, 9, 9, 0, 0.5, 0),
        (0.0, 9, 9, 0, 0.5, 3),
        (1.0, -1.0, -200, 0, 0.5, 2),
        (1.0, -1.01, -100, 0, 0.5, 2),
        (1.0, -1.01, -100.01, 0, 0.5, 0),
        (1.0, 0.99, 9, 0, 0.5, 2),
        (1.0, 1.0, 9, 0, 0.5, 1),
        (1.0, 9, 9, 4.0, 0.5, 1),
        (1.0, 9, 9, 4.01, 0.5, 2),
        (1.0, 1.49, -1, 0, 0.5, 2),
        (1.0, 1.5, -1, 0, 0.5, 1),
        (1.0, 2.5, 9, 2.0, 0.02, 3),
        (1.0, 2.49, 9, 0, 0.5, 1),
        (1.0, 9, 9, 2.01, 0.5, 1),
        (1.0, 9, 9, 0, 0.019, 1),
        (1.0, 9, 9, -3.0, 0.5, 3),
        (None, None, None, None, None, 3),
    ],
)
def test_rule_label(spark, nw, ic, np_, de, om, want):
    row = [None if v is None else float(v) for v in (nw, ic, np_, de, om)]
    df = spark.createDataFrame([row], "nw double, ic double, np double, de double, om double")
    assert df.select(labels.rule_label(F.col("nw"), "ic", "np", "de", "om")).first()[0] == want


def test_override_only_moves_listed_healthy_rows(spark):
    df = spark.createDataFrame([(" MMTC Ltd. ", 3), ("mmtc ltd.", 0), ("Other", 3)], "company string, target int")
    assert [r.target for r in labels.override_labels(df).collect()] == [1, 0, 3]
    listed = spark.createDataFrame([("other",), ("OTHER ",)], "name string")
    got = {(r.company, r.target) for r in labels.override_labels(df, listed).collect()}
    assert got == {(" MMTC Ltd. ", 3), ("mmtc ltd.", 0), ("Other", 1)}


def test_keep_first_with_one_hot_group(spark):
    rows = [(i, "hot", None) for i in range(300)] + [(1000 + i, f"k{i}", 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "pos int, k string, v double")
    out = cleaning.drop_duplicates_keep_first(df, ["k", "v"], ["pos"])
    assert {(r.k, r.pos) for r in out.collect()} == {("hot", 0), *[(f"k{i}", 1000 + i) for i in range(5)]}
    assert cleaning.duplicate_count(df, ["k", "v"]).first()[0] == 299
    assert cleaning.key_duplicate_rows(df, ["k"]).first()[0] == 300


def test_reports_on_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, a double")
    assert cleaning.duplicate_count(empty, ["k"]).first()[0] == 0
    report = cleaning.missing_report(empty, ["a"]).first()
    assert (report.missing_count, report.missing_pct) == (0, None)


@pytest.mark.parametrize(
    "values, want",
    [([1.0, 2.0, 3.0, 10.0], 2.5), ([5.0], 5.0), ([1.0, NAN, None, 3.0, 7.0], 3.0), ([2.0] * 99 + [9.0], 2.0)],
)
def test_exact_median(spark, values, want):
    df = spark.createDataFrame([(v, None) for v in values], "a double, b double")
    assert preprocessing.exact_medians(df, ["a", "b"]) == {"a": want, "b": None}


@pytest.mark.parametrize("n", [4000, 4001])
def test_median_by_counting(spark, monkeypatch, n):
    import random
    import statistics

    rng = random.Random(5)
    values = [rng.lognormvariate(0, 3) for _ in range(n - 1300)] + [-1e300, 1e300] + [0.25] * 1298
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(6)
    for bins in (3, 4096):
        monkeypatch.setattr(preprocessing, "MEDIAN_BINS", bins)
        assert preprocessing.exact_medians(df, ["a"])["a"] == statistics.median(values)


def test_scaler_leaves_constants_centred_and_round_trips(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    scaler = preprocessing.StandardScaler(["a", "b"]).fit(df)
    scaler = preprocessing.StandardScaler.from_json(scaler.to_json())
    assert [tuple(r) for r in scaler.transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_imputer_round_trip(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (4.0,)], "a double")
    imputer = preprocessing.MedianImputer.from_json(preprocessing.MedianImputer(["a"]).fit(df).to_json())
    assert [r.a for r in imputer.transform(df).collect()] == [1.0, 2.5, 2.5, 4.0]


def test_correlation_skips_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, float(-i)) for i in range(9)], "a double, b double, c double, d double")
    got = [(r.feature_1, r.feature_2, r.correlation) for r in preprocessing.correlation_pairs(df, ["a", "b", "c", "d"]).collect()]
    assert got == [("a", "b", 1.0), ("a", "d", -1.0), ("b", "d", -1.0)]


# --- statements -----------------------------------------------------------------------


STATEMENT = "ticker string, statement string, freq string, line_item string, period date, value double"


def landed(spark, rows):
    import datetime

    return spark.createDataFrame([(t, s, f, i, datetime.date(p, 3, 31), v) for t, s, f, i, p, v in rows], STATEMENT)


def test_candidates_and_periods(spark):
    rows = [
        ("A", "income", "annual", "Total Revenue", 2023, None),
        ("A", "income", "annual", "Total Revenue", 2022, 9e7),
        ("A", "income", "annual", "Total Revenue", 2021, 6e7),
        ("A", "income", "annual", "Operating Revenue", 2023, 1e7),
        ("A", "balance", "annual", "Total Debt", 2023, NAN),
        ("A", "balance", "annual", "Long Term Debt", 2023, 4e7),
        ("A", "income", "quarterly", "Total Revenue", 2024, 5e7),
        ("B", "income", "quarterly", "Net Income", 2024, -3e7),
        ("B", "balance", "quarterly", "Total Assets", 2024, 8e7),
        ("C", "income", "annual", "Net Income", 2024, 1e7),
    ]
    df = landed(spark, rows)
    got = {r.ticker: r for r in st.statement_metrics(df).collect()}
    assert set(got) == {"A", "B"}
    assert got["A"].sales == 9.0 and got["A"].borrowings == 4.0 and got["A"].net_profit == 5.0
    assert str(got["A"].latest_period) == "2023-03-31"
    assert got["B"].sales == 100.0 and got["B"].net_profit == -3.0
    assert got["B"].pbt == -3.75 and got["B"].tax == 0.0 and got["B"].liabilities == 8.0 - 50.0
    growth = {r.ticker: r for r in st.growth_rates(df).collect()}
    assert growth["A"].revenue_growth == 0.5 and growth["B"].profit_growth == 0.0
    assert [(r.ticker, r.reason) for r in st.rejected_tickers(df).collect()] == [("C", "balance sheet missing")]


def test_growth_skips_a_zero_base(spark):
    rows = [
        ("A", "income", "annual", "Total Revenue", 2023, 5.0),
        ("A", "income", "annual", "Total Revenue", 2022, 0.0),
        ("A", "income", "annual", "Operating Revenue", 2023, 3.0),
        ("A", "income", "annual", "Operating Revenue", 2022, -2.0),
    ]
    assert st.growth_rates(landed(spark, rows)).first().revenue_growth == 2.5


def test_ratio_guards(spark):
    columns = "sales net_profit operating_profit interest depreciation borrowings equity assets cash receivables inventory working_capital ocf".split()
    zero = spark.createDataFrame([[0.0] * len(columns)], ", ".join(f"{c} double" for c in columns))
    r = st.ratio_block(zero).first()
    assert (r.interest_coverage, r.debt_to_equity, r.cash_to_debt, r.expense_ratio) == (-1.0, -5.0, 1.0, 0.8)
    assert (r.asset_utilization, r.receivable_ratio, r.inventory_ratio, r.depreciation_ratio) == (0.5, 0.1, 0.1, 0.03)
    rich = zero.withColumns({"operating_profit": F.lit(1.0), "borrowings": F.lit(1.0), "equity": F.lit(-2.0)})
    r = st.ratio_block(rich).first()
    assert (r.interest_coverage, r.debt_to_equity, r.roe) == (5.0, 10.0, 0.05)
    split = st.equity_split(rich.withColumns({"icf": F.lit(-1.0), "fcf": F.lit(-2.0)})).first()
    assert (split.equity_share_capital, split.reserves, split.net_cash_flow) == (10.0, -2.0, -3.0)


def test_feature_vector_layout(spark):
    rows = [("A", "income", "annual", "Total Revenue", 2023, 9e7), ("A", "balance", "annual", "Total Assets", 2023, 9e7)]
    out = st.feature_vector(landed(spark, rows))
    assert out.columns == ["ticker", "latest_period", *AUDITED_FEATURES]
    r = out.first()
    assert sum(v is not None for v in r[2:]) == 37
    assert len(name_map()) == 61


# --- splits ------------------------------------------------------------------------------


def test_folds_keep_companies_together_even_with_a_giant(spark):
    rows = [("giant", i % 4) for i in range(400)] + [(f"c{i}", i % 4) for i in range(200) for _ in range(1 + i % 5)]
    df = spark.createDataFrame(rows, "company string, target int")
    split = splitting.group_split(df)
    check = splitting.leakage_check(split).first()
    assert check.overlap == 0 and check.train_groups + check.test_groups == 201
    assert split.count() == len(rows)
    splitting.assert_no_leakage(split)
    with pytest.raises(ValueError):
        splitting.assert_no_leakage(df.withColumn("fold", (F.col("target") % 2).cast("int")))


def test_stratified_folds_are_even(spark):
    df = spark.range(1003).select(F.col("id"), F.when(F.col("id") < 900, 3).otherwise(0).alias("target"))
    counts = splitting.stratified_folds(df, ["id"]).groupBy("target", "fold").count().collect()
    for target, n in ((3, 900), (0, 103)):
        sizes = [r["count"] for r in counts if r.target == target]
        assert len(sizes) == 5 and sum(sizes) == n and max(sizes) - min(sizes) <= 1


# --- metrics -----------------------------------------------------------------------------

# Published per-class rows (precision, recall, F1, support) and their averages.
GOLDEN_ROWS = [
    (0, 0.5980392156862745, 0.6703296703296703, 0.6321243523316062, 91),
    (1, 0.3137254901960784, 0.5517241379310345, 0.4, 29),
    (2, 0.7469879518072289, 0.7948717948717948, 0.7701863354037267, 78),
    (3, 0.957089552238806, 0.8937282229965157, 0.9243243243243243, 574),
]
GOLDEN_MACRO = (0.653960552482097, 0.7276634565322538, 0.6816587530149143)
GOLDEN_WEIGHTED = (0.8693705583797613, 0.844559585492228, 0.8546114150075504)


def test_averages_equal_published_ones(spark):
    table = spark.createDataFrame(GOLDEN_ROWS, "label int, precision double, recall double, f1 double, support bigint")
    got = {r.label: (r.precision, r.recall, r.f1) for r in metrics.averages_of(table).collect()}
    assert got["macro avg"] == pytest.approx(GOLDEN_MACRO, abs=1e-9)
    assert got["weighted avg"] == pytest.approx(GOLDEN_WEIGHTED, abs=1e-9)


def test_missing_classes_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "target int, pred int")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in metrics.per_class_metrics(df).collect()}
    assert got == {0: (0.5, 0.5, 0.5, 2), 1: (0.0, 0.0, 0.0, 0), 2: (0.0, 0.0, 0.0, 1)}
    cells = {r.target: (r.pred_0, r.pred_1, r.pred_2, r.pred_3) for r in metrics.confusion_matrix(df).collect()}
    assert cells == {0: (1, 1, 0, 0), 1: (0, 0, 0, 0), 2: (1, 0, 0, 0), 3: (0, 0, 0, 0)}


def test_auc_counts_pairs(spark):
    import random

    rng = random.Random(11)
    rows = [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.35, 0.5, 0.8])) for _ in range(400)]
    df = spark.createDataFrame([(y, 1 - s, s) for y, s in rows], "target int, a double, b double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = {r.class_id: r.auc for r in metrics.roc_auc(df, ["a", "b"], buckets=4).collect()}
    assert got[1] == pytest.approx(want, abs=1e-12) and got[0] == pytest.approx(want, abs=1e-12)


def test_macro_curve_equals_interpolation(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    rows = []
    for _ in range(300):
        y = rng.randint(0, 2)
        p = [round(rng.random() + (k == y) * 0.4, 2) for k in range(3)]
        rows.append((y, *[v / sum(p) for v in p]))
    df = spark.createDataFrame(rows, "target int, a double, b double, c double")
    for drop in (True, False):
        points = metrics.roc_curve(df, ["a", "b", "c"], drop_collinear=drop, buckets=5).collect()
        curves = {}
        for k in range(3):
            pts = sorted((r.fp, r.tp, r.fpr, r.tpr) for r in points if r.class_id == k)
            curves[k] = ([p[2] for p in pts], [p[3] for p in pts])
        grid = np.unique(np.concatenate([c[0] for c in curves.values()]))
        mean = sum(np.interp(grid, *curves[k]) for k in range(3)) / 3
        got = sorted((r.fpr, r.mean_tpr) for r in metrics.roc_macro(df, ["a", "b", "c"], drop_collinear=drop, buckets=5).collect())
        assert np.allclose([g[0] for g in got], grid) and np.allclose([g[1] for g in got], mean)
        area = metrics.curve_area(metrics.roc_macro(df, ["a", "b", "c"], drop_collinear=drop), buckets=5).first().auc
        assert area == pytest.approx(float(np.trapezoid(mean, grid)), abs=1e-9)


def test_best_model_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([("b", 0.9, 0.5, 0.1), ("a", 0.9, 0.6, 0.1)], "model string, accuracy double, macro_f1 double, recall_0 double")
    got = {r.metric: r.model for r in metrics.best_models(df, {"a": 0, "b": 1}).collect()}
    assert got == {"accuracy": "a", "macro_f1": "a", "recall_0": "a"}


# --- reports -------------------------------------------------------------------------------


def factors(spark, rows, pred):
    df = spark.createDataFrame([(1, pred, f, p, 1.0) for f, p in rows], "id int, pred int, feature string, phi double, actual double")
    return [(r.side, r["rank"], r.feature, r.impact) for r in reporting.risk_factors(df, ["id"]).orderBy("side", "rank").collect()]


def test_factor_thresholds_and_limits(spark):
    rows = [
        ("ROA", 0.04),
        ("ROE", 0.0399),
        ("Borrowings", -0.05),
        ("Net profit", -0.0499),
        ("Sales", 9.0),
        ("Interest_Coverage", 0.5),
        ("Debt_to_Equity", 0.4),
        ("Operating_Margin", 0.3),
        ("Operating Profit", 0.2),
        ("Cash_to_Debt", -0.2),
        ("Revenue_Growth", -0.3),
        ("Profit_Growth", -0.4),
    ]
    healthy = factors(spark, rows, 3)
    assert [f for s, _, f, _ in healthy if s == "health"] == ["Interest_Coverage", "Debt_to_Equity", "Operating_Margin", "Operating Profit"]
    assert [f for s, _, f, _ in healthy if s == "risk"] == ["Profit_Growth", "Revenue_Growth", "Cash_to_Debt"]
    assert healthy[0][3] == "+0.50 toward Healthy" and ("risk", 1, "Profit_Growth", "-0.40") in healthy
    sick = factors(spark, rows, 1)
    assert len([1 for s, *_ in sick if s == "risk"]) == 4
    assert [(f, i) for s, _, f, i in sick if s == "health"] == [("Profit_Growth", "+0.40 buffer"), ("Revenue_Growth", "+0.30 buffer")]


def test_zero_attribution_is_adverse(spark):
    df = spark.createDataFrame([(0.0, 3), (0.0, 0), (0.1, 3), (-0.1, 0)], "phi double, pred int")
    assert [r[0] for r in df.select(reporting.supports_health("phi", "pred")).collect()] == [False, False, True, True]


@pytest.mark.parametrize(
    "position, value, status",
    [
        (0, 2.5, "Strong"), (0, 1.5, "Moderate"), (0, 1.0, "Concerning"), (0, 0.99, "Critical"), (0, None, "Unknown"),
        (1, -0.01, "Critical"), (1, 10.0, "Critical"), (1, 3.01, "Concerning"), (1, 3.0, "Moderate"), (1, 1.5, "Strong"), (1, 0.0, "Strong"),
        (2, 0.12, "Strong"), (2, 0.05, "Moderate"), (2, 0.0, "Concerning"), (2, -0.01, "Critical"),
        (3, 0.05, "Strong"), (3, 0.01, "Moderate"), (4, 0.12, "Strong"), (5, 0.15, "Strong"), (5, 0.05, "Moderate"),
    ],
)
def test_indicator_cut_offs(spark, position, value, status):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(reporting.indicator(position, "v").alias("i")).first().i.status == status
    assert len(INDICATORS) == 6


def test_lookups(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 1), ("b", 2, 0), (None, 9, 1)], "company string, year int, target int")
    assert {(r.company, r.year) for r in lookup.latest_filing(df).collect()} == {("a", 3), ("b", 2), (None, 9)}
    found = lookup.company_search(df, "^A", "year").collect()
    assert [r.company for r in found] == ["a"]
    assert lookup.seeded_sample(df, 2, ["year"]).count() == 2
    assert lookup.scenario_vectors(lookup.presets(spark), ["scenario"]).count() == 4


def test_item_ranking_equals_the_ranking_of_exploded_rows(spark):
    rows = [
        ("a", [("x", 1.0), ("y", -3.0), ("z", None)]),
        ("b", [("x", -2.0), ("y", 0.5), ("z", 4.0)]),
        ("c", [("z", 2.0), ("x", None)]),
        ("d", []),
        ("e", None),
    ]
    df = spark.createDataFrame(rows, "id string, items array<struct<feature:string,phi:double>>")
    got = [tuple(r) for r in reporting.item_ranking(df).collect()]
    assert got == [tuple(r) for r in reporting.attribution_ranking(df.select(F.inline("items"))).collect()]
    assert [r[0] for r in got] == ["z", "y", "x"]
    assert reporting.item_ranking(df.limit(0)).count() == 0


def test_stage_counts_of_rows_that_vanish_and_double(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), ("b", 0)], "k string, n int")
    stages = {"raw": (F.lit(1), 2), "copied": (F.col("n"), 3)}
    got = {r.stage: (r.rows, r.columns) for r in cleaning.stage_counts(df, stages, {"unique": ("copied", ["k"], 3)}).collect()}
    assert got == {"raw": (4, 2), "copied": (4, 3), "unique": (2, 3)}
    empty = {r.stage: r.rows for r in cleaning.stage_counts(df.limit(0), stages, {"unique": ("copied", ["k"], 3)}).collect()}
    assert set(empty.values()) == {0}
