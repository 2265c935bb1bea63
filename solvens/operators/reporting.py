"""Risk reports: factors, explanations, summaries, indicator snapshots.

Everything is keyed by a report row (for example company and year).  A row has
at most one line per feature, so lists per row stay small.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from solvens.functions.arrays import argmax, confidence, percent_map
from solvens.functions.numeric import col, fixed_text, percent_text, round_half_even
from solvens.functions.text import class_name, format_value, literal_map
from solvens.functions import wording
from solvens.schemas import CLASS_NAMES, ESSENTIAL_FEATURES, FEATURE_DISPLAY_NAMES, HEALTHY

# Thresholds and list lengths of the factor selection.
POSITIVE_PHI = 0.04
NEGATIVE_PHI = -0.05
POSITIVE_LIMIT = 4
NEGATIVE_LIMIT_HEALTHY = 3
NEGATIVE_LIMIT_OTHER = 2


def friendly_name(feature) -> Column:
    known = F.try_element_at(literal_map(FEATURE_DISPLAY_NAMES), col(feature))
    return F.coalesce(known, F.replace(col(feature), F.lit("_"), F.lit(" ")))


def essential_only(df: DataFrame, feature: str = "feature") -> DataFrame:
    return df.filter(F.col(feature).isin(ESSENTIAL_FEATURES))


def top_attributions(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` strongest features per row; ``rank`` 1 is the strongest."""
    w = W.partitionBy(*keys).orderBy(F.abs("phi").desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def attribution_ranking(df: DataFrame, k: int = 20) -> DataFrame:
    """Mean absolute attribution over rows and classes, the ``k`` largest."""
    mean = F.avg(F.abs("phi"))
    return df.groupBy("feature").agg(mean.alias("mean_abs_phi")).orderBy(F.col("mean_abs_phi").desc(), "feature").limit(k)


def item_ranking(df: DataFrame, items: str = "items", k: int = 20) -> DataFrame:
    """``attribution_ranking`` of rows that carry their attributions as an array.

    Arrays are summed place by place within each order of names that occurs (usually one), before anything is exploded: a task
    hands on one vector, not a row per feature.  A missing attribution leaves its row out of the feature's mean.
    """
    names = F.transform(items, lambda f: f["feature"]).alias("_names")
    there = F.transform(items, lambda f: f["phi"].isNotNull().cast("double"))
    size = F.transform(items, lambda f: F.coalesce(F.abs(f["phi"]), F.lit(0.0)))
    rows = df.filter(F.size(items) > 0).select(names, array_to_vector(size).alias("_size"), array_to_vector(there).alias("_there"))
    sums = rows.groupBy("_names").agg(Summarizer.sum(F.col("_size")).alias("_size"), Summarizer.sum(F.col("_there")).alias("_there"))
    each = sums.select(F.inline(F.arrays_zip(F.col("_names").alias("feature"), vector_to_array("_size").alias("s"), vector_to_array("_there").alias("n"))))
    mean = (F.sum("s") / F.nullif(F.sum("n"), F.lit(0.0))).alias("mean_abs_phi")
    return each.toDF("feature", "s", "n").groupBy("feature").agg(mean).orderBy(F.col("mean_abs_phi").desc(), "feature").limit(k)


def supports_health(phi, predicted) -> Column:
    """True when the attribution speaks for health; zero counts as adverse."""
    return F.when(col(predicted) == HEALTHY, col(phi) > 0).otherwise(col(phi) < 0)


# --- sentences -----------------------------------------------------------------


def _fill(sentence: str, parts: dict[str, Column]) -> Column:
    """Concatenate literal pieces and columns of a template with ``{key}`` slots."""
    pieces: list[Column] = []
    rest = sentence
    while "{" in rest:
        head, tail = rest.split("{", 1)
        key, rest = tail.split("}", 1)
        if head:
            pieces.append(F.lit(head))
        pieces.append(F.coalesce(parts[key], F.lit("N/A")))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _value_parts(feature: Column, value: Column) -> dict[str, Column]:
    return {
        "x": F.concat(fixed_text(value, 2), F.lit("x")),
        "n": fixed_text(value, 2),
        "p": percent_text(value),
        "t": format_value(feature, value),
        "name": friendly_name(feature),
    }


_COMPARE = {"<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def _meets(test: str | None, value: Column) -> Column:
    """Column of a rule's test, e.g. ``v >= 10.0 or v < 0``; a missing value meets none."""
    if test is None:
        return F.lit(True)
    parts = [_COMPARE[op](value, float(limit)) for _, op, limit in (t.split() for t in test.split(" or "))]
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


def explanation(feature: Column, value: Column, side: Column, concise: bool = False, parts: dict[str, Column] | None = None) -> Column:
    """The sentence for a feature, its value and the side it is listed on."""
    rules, other = (
        (wording.CONCISE, wording.CONCISE_OTHER) if concise else (wording.DETAILED, wording.DETAILED_OTHER)
    )
    parts = parts or _value_parts(feature, value)

    def chain(branches) -> Column:
        out = None
        for test, on_side, sentence in branches:
            cond = _meets(test, value)
            if on_side:
                cond = cond & (side == on_side)
            text = _fill(sentence, parts)
            out = F.when(cond, text) if out is None else out.when(cond, text)
        return out

    text = None
    for f, branches in rules.items():
        text = F.when(feature == f, chain(branches)) if text is None else text.when(feature == f, chain(branches))
    return text.otherwise(chain(other))


def explain(df: DataFrame, feature: str = "feature", value: str = "actual", side: str = "side", concise: bool = False, name: str = "explanation") -> DataFrame:
    """Add the explanation to a long table."""
    # Texts become columns first, so that each is computed once and not per branch.
    texts = _value_parts(F.col(feature), F.col(value))
    work = df.withColumns({f"_p_{k}": c for k, c in texts.items()})
    parts = {k: F.col(f"_p_{k}") for k in texts}
    text = explanation(F.col(feature), F.col(value), F.col(side), concise, parts)
    return work.withColumn(name, text).drop(*[f"_p_{k}" for k in texts])


def _impact(phi: Column, positive, healthy: Column) -> Column:
    size = fixed_text(phi, 2)
    plus = F.concat(F.lit("+"), size)
    return (
        F.when(positive & healthy, F.concat(plus, F.lit(" toward Healthy")))
        .when(positive, plus)
        .when(healthy, size)
        .otherwise(F.concat(F.lit("+"), fixed_text(F.abs(phi), 2), F.lit(" buffer")))
    )


def risk_factors(df: DataFrame, keys: list[str], predicted: str = "pred", concise: bool = False) -> DataFrame:
    """Selected factors per row: drivers of the predicted class and what speaks against it.

    ``df`` has one line per key and feature with ``phi``, ``actual`` and the
    predicted class code.
    """
    healthy = F.col(predicted) == HEALTHY
    picked = essential_only(df).withColumn(
        "_sign", F.when(F.col("phi") >= POSITIVE_PHI, 1).when(F.col("phi") <= NEGATIVE_PHI, -1)
    ).filter(F.col("_sign").isNotNull())
    w = W.partitionBy(*keys, "_sign").orderBy(F.abs("phi").desc(), "feature")
    limit = (
        F.when(F.col("_sign") == 1, POSITIVE_LIMIT)
        .when(healthy, NEGATIVE_LIMIT_HEALTHY)
        .otherwise(NEGATIVE_LIMIT_OTHER)
    )
    ranked = picked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= POSITIVE_LIMIT)
    ranked = ranked.filter(F.col("rank") <= limit)
    side = F.when((F.col("_sign") == 1) == healthy, F.lit(wording.HEALTH)).otherwise(F.lit(wording.RISK))
    impact = _impact(F.col("phi"), F.col("_sign") == 1, healthy)
    out = ranked.withColumns(
        {
            "side": side,
            "name": friendly_name("feature"),
            "actual_text": format_value("feature", "actual"),
            "impact": impact,
            "phi_shown": round_half_even("phi", 4),
            "supports_health": supports_health("phi", predicted),
        }
    )
    return explain(out, concise=concise).drop("_sign")


def factor_array(items, predicted, concise: bool = False) -> Column:
    """The same selection on a row that carries its attributions as an array.

    ``items`` is an array of (feature, phi, actual).  Everything happens inside
    the row: no attribution is exploded, shuffled or collected again.
    """
    items, healthy = col(items), col(predicted) == HEALTHY

    def strongest(keep, positive: bool, limit) -> Column:
        kept = F.filter(items, lambda f: f["feature"].isin(ESSENTIAL_FEATURES) & keep(f["phi"]))
        by_size = F.transform(
            kept,
            lambda f: F.struct(
                (-F.abs(f["phi"])).alias("order"),
                f["feature"].alias("feature"),
                f["phi"].alias("phi"),
                f["actual"].alias("actual"),
            ),
        )
        first = F.slice(F.array_sort(by_size), F.lit(1), limit)
        return F.transform(first, lambda f, i: F.struct((i + 1).alias("rank"), F.lit(positive).alias("positive"), f.alias("f")))

    few = F.when(healthy, F.lit(NEGATIVE_LIMIT_HEALTHY)).otherwise(F.lit(NEGATIVE_LIMIT_OTHER))
    picked = F.concat(
        strongest(lambda phi: phi >= POSITIVE_PHI, True, F.lit(POSITIVE_LIMIT)),
        strongest(lambda phi: phi <= NEGATIVE_PHI, False, few),
    )

    def describe(p: Column) -> Column:
        f, phi = p["f"], p["f"]["phi"]
        side = F.when(p["positive"] == healthy, F.lit(wording.HEALTH)).otherwise(F.lit(wording.RISK))
        return F.struct(
            side.alias("side"),
            p["rank"].alias("rank"),
            f["feature"].alias("feature"),
            friendly_name(f["feature"]).alias("name"),
            format_value(f["feature"], f["actual"]).alias("actual_text"),
            _impact(phi, p["positive"], healthy).alias("impact"),
            round_half_even(phi, 4).alias("phi_shown"),
            explanation(f["feature"], f["actual"], side, concise).alias("explanation"),
        )

    return F.transform(picked, describe)


def _on_side(factors: str, side: str) -> Column:
    return F.filter(factors, lambda f: f["side"] == side)


def with_items(rows: DataFrame, attributions: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a long attribution table as an array per row; a row has one line per feature."""
    nested = attributions.groupBy(*keys).agg(F.collect_list(F.struct("feature", "phi", "actual")).alias("items"))
    return rows.join(nested, keys, "left")


def summary_text(predicted, conf, coverage, leverage, margin, risk_names, health_names) -> Column:
    """Executive summary by predicted class; names are arrays, the first two are used."""
    text = None
    for code, name in enumerate(CLASS_NAMES):
        sentence, side, fallback = wording.SUMMARIES[name]
        names = F.slice(col(health_names if side == wording.HEALTH else risk_names), 1, 2)
        factors = F.when(F.size(names) > 0, F.array_join(names, " and ")).otherwise(F.lit(fallback))
        parts = {
            "conf": fixed_text(conf, 2),
            "ic": F.concat(fixed_text(coverage, 2), F.lit("x")),
            "de": F.concat(fixed_text(leverage, 2), F.lit("x")),
            "om": percent_text(margin),
            "factors": factors,
        }
        filled = _fill(sentence, parts)
        text = F.when(col(predicted) == code, filled) if text is None else text.when(col(predicted) == code, filled)
    return text


# --- indicators ----------------------------------------------------------------


def _status(value: Column, cuts) -> Column:
    if cuts is None:
        # Debt to equity: low is good, negative means equity is gone.
        return (
            F.when((value < 0) | (value >= 10.0), F.lit("Critical"))
            .when(value > 3.0, F.lit("Concerning"))
            .when(value > 1.5, F.lit("Moderate"))
            .when(value.isNotNull(), F.lit("Strong"))
        )
    out = None
    for status, cut in zip(wording.STATUSES, cuts):
        out = F.when(value >= cut, F.lit(status)) if out is None else out.when(value >= cut, F.lit(status))
    return out.when(value.isNotNull(), F.lit("Critical"))


def indicator(position: int, value, missing_as_zero: bool = False, rounded: bool = False) -> Column:
    """Struct with the six columns of one snapshot line.

    By default a missing value has the status Unknown and the raw value is
    tested; ``missing_as_zero`` and ``rounded`` test the value a reader would see.
    """
    name, _, kind, benchmark, cuts, good_from, good, bad = wording.INDICATORS[position]
    value = col(value)
    if missing_as_zero:
        value = F.coalesce(value, F.lit(0.0))
    shown = {
        "x": F.concat(fixed_text(value, 2), F.lit("x")),
        "p": percent_text(value),
        "n": fixed_text(value, 2),
    }[kind]
    tested = value
    if rounded:
        tested = round_half_even(value * 100, 1) / 100 if kind == "p" else round_half_even(value, 2)
    status = F.coalesce(_status(tested, cuts), F.lit("Unknown"))
    fine = (tested <= 1.5) & (tested > 0) if cuts is None else tested >= good_from
    note = F.when(tested.isNull(), F.lit("Not reported")).when(fine, F.lit(good)).otherwise(F.lit(bad))
    return F.struct(
        F.lit(name).alias("metric"),
        F.coalesce(shown, F.lit("N/A")).alias("value"),
        F.lit(benchmark).alias("benchmark"),
        status.alias("status"),
        F.element_at(literal_map(wording.COLOURS), status).alias("colour"),
        note.alias("implication"),
    )


def snapshot_array(available: list[str], missing_as_zero: bool = False, rounded: bool = False) -> Column:
    columns = [F.col(c) if c in available else F.lit(None).cast("double") for _, c, *_ in wording.INDICATORS]
    return F.array(*[indicator(i, c, missing_as_zero, rounded) for i, c in enumerate(columns)])


def health_snapshot(df: DataFrame, keys: list[str], missing_as_zero: bool = False, rounded: bool = False) -> DataFrame:
    """Six indicator lines per row, from one pass over the rows."""
    return df.select(*keys, F.inline(snapshot_array(df.columns, missing_as_zero, rounded)))


# --- the report ----------------------------------------------------------------


def score_columns(df: DataFrame, probs: str = "probs") -> DataFrame:
    """Class code, class name, confidence and percentages of a probability array."""
    scored = df.withColumn("pred", argmax(probs))
    return scored.withColumns(
        {"prediction": class_name("pred"), "confidence": confidence(probs), "probabilities": percent_map(probs)}
    )


def risk_report(scored: DataFrame, keys: list[str], title: Column, subtitle: Column, items: str = "items", concise: bool = False) -> DataFrame:
    """One nested document per scored row.

    ``scored`` holds the probability array, the ratio columns and the row's
    attributions for its predicted class (array of feature, phi, actual).  The
    whole report is a projection: it needs no shuffle.
    """
    rows = score_columns(scored)
    listed = F.coalesce(F.col(items), F.expr("cast(array() as array<struct<feature:string,phi:double,actual:double>>)"))
    full = rows.withColumn("_factors", factor_array(listed, "pred", concise))
    full = full.withColumns(
        {"risk_factors": _on_side("_factors", wording.RISK), "health_factors": _on_side("_factors", wording.HEALTH)}
    )
    names = lambda c: F.transform(c, lambda f: f["name"])
    summary = summary_text(
        "pred",
        "confidence",
        "interest_coverage",
        "debt_to_equity",
        "operating_margin",
        names("risk_factors"),
        names("health_factors"),
    )
    chart = F.transform(
        F.concat("health_factors", "risk_factors"),
        lambda f: F.struct(
            f["name"].alias("feature"),
            f["phi_shown"].alias("value"),
            f["actual_text"].alias("actual"),
            F.when(supports_health(f["phi_shown"], F.col("pred")), F.lit("good")).otherwise(F.lit("bad")).alias("tone"),
        ),
    )
    ratios = F.array(
        *[
            F.struct(F.lit(n).alias("name"), format_value(F.lit(n), F.col(c)).alias("text"))
            for n, c in RATIO_LINES.items()
            if c in scored.columns
        ]
    )
    return full.select(
        *keys,
        title.alias("name"),
        subtitle.alias("subtitle"),
        "prediction",
        "confidence",
        "probabilities",
        ratios.alias("ratios"),
        summary.alias("summary"),
        "risk_factors",
        "health_factors",
        snapshot_array(scored.columns).alias("snapshot"),
        chart.alias("chart"),
    )


RATIO_LINES = {
    "Sales": "sales",
    "Net profit": "net_profit",
    "Borrowings": "borrowings",
    "Interest_Coverage": "interest_coverage",
    "Debt_to_Equity": "debt_to_equity",
    "Operating_Margin": "operating_margin",
    "ROA": "roa",
    "ROE": "roe",
    "Working_Capital_Ratio": "working_capital_ratio",
}


def report_json(report: DataFrame, keys: list[str]) -> DataFrame:
    """Each report as one JSON text."""
    body = [c for c in report.columns if c not in keys]
    return report.select(*keys, F.to_json(F.struct(*body)).alias("document"))
