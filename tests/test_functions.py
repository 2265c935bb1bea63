"""Column functions against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from solvens.functions import arrays, numeric, ordering, text
from solvens.functions.wording import HEALTH, RISK
from solvens.operators import reporting

NAN, INF = float("nan"), float("inf")


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_nan_becomes_null(spark):
    assert column(spark, [1.0, NAN, None, INF], numeric.nan_to_null("v")) == [1.0, None, None, INF]


def test_to_double_accepts_plain_numbers_only(spark):
    texts = ['"12.5"', "NA", "", "1.0d", "0x1p3", "inf", "-Infinity", "1e5", ".5", "5.", " 7 ", None, "1,000", "1_000", "NaN", "-3"]
    want = [12.5, None, None, None, None, INF, -INF, 1e5, 0.5, 5.0, 7.0, None, None, None, None, -3.0]
    assert column(spark, texts, numeric.to_double("v"), "string") == want
    assert column(spark, ["inf", "2"], numeric.to_double("v", allow_inf=False), "string") == [None, 2.0]


def test_guarded_ratio_boundaries(spark):
    df = spark.createDataFrame([(6.0, 2.0), (6.0, 0.0), (6.0, -1.0), (6.0, None)], "n double, d double")
    got = [r[0] for r in df.select(numeric.guarded_ratio("n", "d", 0.05)).collect()]
    assert got == [3.0, 0.05, 0.05, 0.05]


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [2.675, 0.125, -0.125, 0.375, 1e-9, -0.001, 12345.65, 1e15, 999999.995]
    values += [round(rng.uniform(-50, 50), 3) for _ in range(5000)] + [rng.uniform(-1e6, 1e6) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(
        "v",
        numeric.fixed_text("v", 2).alias("a"),
        numeric.fixed_text("v", 1, thousands=True).alias("b"),
        numeric.percent_text("v").alias("c"),
        numeric.round_half_even("v", 2).alias("d"),
    ).collect()
    for r in rows:
        assert (r.a, r.b, r.c, r.d) == (f"{r.v:.2f}", f"{r.v:,.1f}", f"{r.v:.1%}", round(r.v, 2))


def test_labels(spark):
    texts = ["Bankrupt", " FINANCIAL distress ", "Probable Bankrupt", "probably bankrupt", "HEALTHY", "other", None]
    got = column(spark, texts, text.standard_label("v"), "string")
    assert got == ["Bankrupt", "Financial Distress", "Probably Bankrupt", "Probably Bankrupt", "Healthy", None, None]


def test_tickers(spark):
    got = column(spark, [" suzlon ", "500325", "tcs.bo", "A.B", "12a"], text.normalize_ticker("v"), "string")
    assert got == ["SUZLON.NS", "500325.BO", "TCS.BO", "A.B", "12A.NS"]


@pytest.mark.parametrize(
    "name, value, shown",
    [
        ("Interest_Coverage", 2.5, "2.50x"),
        ("Cash_to_Debt", 0.1, "0.10x"),
        ("Operating_Margin", 0.125, "12.5%"),
        ("Revenue_Growth", 10.0, "10.00"),
        ("Revenue_Growth", -9.99, "-999.0%"),
        ("Working_Capital_Ratio", 0.15, "15.0%"),
        ("Net profit", 1234567.25, "₹1,234,567.2 Cr"),
        ("Dividend Amount", 3.0, "3.00"),
        ("Sales", None, "N/A"),
        ("Sales", NAN, "N/A"),
    ],
)
def test_format_value(spark, name, value, shown):
    df = spark.createDataFrame([(name, value)], "n string, v double")
    assert df.select(text.format_value("n", "v")).first()[0] == shown


def test_parse_value(spark):
    got = column(spark, ["₹1,234.5 Cr", "2.50x", "12.5%", "N/A", "", "-3"], text.parse_value("v"), "string")
    assert got == [1234.5, 2.5, 0.125, 0.0, 0.0, -3.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=9))
def test_row_statistics(spark, values):
    import statistics

    df = spark.createDataFrame([(values,)], "v array<double>")
    r = df.select(arrays.row_mean(F.col("v")), arrays.row_std(F.col("v")), arrays.row_median(F.col("v"))).first()
    assert r[0] == pytest.approx(statistics.fmean(values), abs=1e-6)
    assert r[2] == pytest.approx(statistics.median(values), abs=1e-6)
    if len(values) > 1:
        assert r[1] == pytest.approx(statistics.stdev(values), abs=1e-5)
    else:
        assert r[1] is None


def test_argmax_takes_first_on_ties(spark):
    assert column(spark, [[0.4, 0.4, 0.1, 0.1], [0.1, 0.2, 0.3, 0.4]], arrays.argmax("v"), "array<double>") == [0, 3]


def test_cascade_threshold(spark):
    df = spark.createDataFrame([(0.40, [0.9, 0.1, 0.0]), (0.3999, [0.1, 0.2, 0.7])], "g double, s array<double>")
    rows = df.select(arrays.cascade_class("g", "s").alias("c"), arrays.cascade_probabilities("g", "s").alias("p")).collect()
    assert [r.c for r in rows] == [3, 2]
    assert rows[0].p == pytest.approx([0.54, 0.06, 0.0, 0.40])
    # The threshold overrules the largest combined probability.
    assert max(range(4), key=lambda i: rows[0].p[i]) == 0


def test_blend(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(arrays.weighted_blend(["a", "b"], [0.3, 0.7])).first()[0] == pytest.approx([0.3, 0.7])
    with pytest.raises(ValueError):
        arrays.weighted_blend(["a"], [0.5, 0.5])


# --- order helpers against plain windows --------------------------------------------


@pytest.fixture(scope="module")
def ordered(spark):
    rng = random.Random(3)
    values = rng.sample(range(100000), 900)
    # One part holds most rows.
    return [(0 if i % 10 else 1, float(v), rng.randint(0, 9)) for i, v in enumerate(values)]


def test_running_totals(spark, ordered):
    df = spark.createDataFrame(ordered, "p int, x double, n bigint")
    got = {(r.p, r.x): r.cum_n for r in ordering.running_totals(df, ["p"], "x", ["n"], 16).collect()}
    for part in (0, 1):
        total = 0
        for p, x, n in sorted(r for r in ordered if r[0] == part):
            total += n
            assert got[(p, x)] == total
    assert len(got) == len(ordered)


@pytest.mark.parametrize("ahead", [True, False])
def test_neighbours_in_order(spark, ordered, ahead):
    df = spark.createDataFrame(ordered, "p int, x double, n bigint")
    name = "next_x" if ahead else "prev_x"
    got = {(r.p, r.x): r[name] for r in ordering.with_neighbour(df, ["p"], "x", ["x"], ahead, 16).collect()}
    for part in (0, 1):
        xs = sorted(x for p, x, _ in ordered if p == part)
        xs = xs if ahead else xs[::-1]
        for a, b in zip(xs, [*xs[1:], None]):
            assert got[(part, a)] == b


def test_row_numbers(spark, ordered):
    df = spark.createDataFrame(ordered, "p int, x double, n bigint").withColumn("h", F.floor(F.col("x") / 1000))
    got = {(r.p, r.n, r.x): r.pos for r in ordering.row_numbers(df, ["p"], ["n", "h"], ["x"], "pos").collect()}
    for part in (0, 1):
        rows = sorted((n, x) for p, x, n in ordered if p == part)
        assert [got[(part, n, x)] for n, x in rows] == list(range(1, len(rows) + 1))


# --- sentences -------------------------------------------------------------------------


def sentence(spark, feature, value, side, concise=False):
    df = spark.createDataFrame([(feature, value, side)], "feature string, actual double, side string")
    return reporting.explain(df, concise=concise).first().explanation


@pytest.mark.parametrize(
    "feature, low, high",
    [
        ("Interest_Coverage", -0.01, 0.0),
        ("Interest_Coverage", 0.99, 1.0),
        ("Interest_Coverage", 1.99, 2.0),
        ("Debt_to_Equity", 1.5, 1.51),
        ("Debt_to_Equity", 3.0, 3.01),
        ("Debt_to_Equity", 9.99, 10.0),
        ("Operating_Margin", 0.0499, 0.05),
        ("ROA", 0.0299, 0.03),
        ("Cash_to_Debt", 0.0999, 0.1),
        ("Borrowing_Growth", 0.15, 0.1501),
        ("Borrowing_Growth", 0.0, 0.0001),
    ],
)
def test_explanations_change_at_their_limits(spark, feature, low, high):
    import re

    bare = lambda s: re.sub(r"-?[0-9.]+[x%]?", "", s)
    assert bare(sentence(spark, feature, low, RISK)) != bare(sentence(spark, feature, high, RISK))


def test_explanation_side_and_fallback(spark):
    assert sentence(spark, "Borrowings", 5.0, RISK) != sentence(spark, "Borrowings", 5.0, HEALTH)
    assert "Fixed Assets / Net Block" in sentence(spark, "Net Block", 5.0, RISK)
    assert "Strange Thing" in sentence(spark, "Strange_Thing", 1.0, HEALTH)
    assert "N/A" in sentence(spark, "Net profit", None, RISK)
    assert "Asset Growth" in sentence(spark, "Asset_Growth", 0.1, RISK, concise=True)
