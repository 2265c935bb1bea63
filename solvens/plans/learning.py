"""Training, scoring and explanation runs.

Numbers of trees and rounds are small here so that a check takes seconds; the
presets in ``solvens.ml.models`` hold the full ones.  Rows are never cut.
Where results depend on a library's random numbers, a query returns what must
hold of them; ``training_results`` returns the figures themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax
from solvens.ml import models, training
from solvens.ml.attribution import base_values, tree_attributions
from solvens.ml.boosting import SoftmaxBoost
from solvens.ml.scoring import Registry, explain_scores, explained_statements, live_reports
from solvens.ml.stages import Preprocess
from solvens.operators import cleaning, lookup, metrics, splitting
from solvens.operators import statements as st
from solvens.operators.features import Terms
from solvens.operators.neighbours import distinct_points, nearest_points
from solvens.operators.reporting import NEGATIVE_LIMIT_HEALTHY, POSITIVE_LIMIT, attribution_ranking
from solvens.operators.resampling import smote
from solvens.plans.base import with_tables
from solvens.plans.evaluation import FOLDS
from solvens.schemas import CLASS_NAMES, RULE_INPUTS
from solvens.session import materialise, scratch_path
from solvens.sources import tables
from solvens.sources.tables import FILING_FEATURES

#: Boosting runs 20 rounds of its presets with all else as published, forests grow to ``FOREST``; the regression runs as published.
FOREST = {"trees": 50, "depth": 10}
SMALL = {
    "random_forest": FOREST,
    "extra_trees": FOREST,
    "boost_a": {"rounds": 20},
    "boost_b": {"rounds": 20},
    "boost_c": {"rounds": 20},
}
#: Engineered features of filings: counts and statistics of the row, quotients and a product.
FILING_TERMS = Terms(
    quotients={"profit_to_debt": ("net_profit", "borrowings"), "interest_to_sales": ("interest", "sales")},
    products={"margin_by_coverage": ("operating_margin", "interest_coverage")},
)
#: Statement features that filings have, by their name in the audited layout.
LIVE_FEATURES = {
    "Sales": "sales",
    "Net profit": "net_profit",
    "Operating Profit": "operating_profit",
    "Interest": "interest",
    "Borrowings": "borrowings",
    "Equity Share Capital": "equity_share_capital",
    "Reserves": "reserves",
    "Interest_Coverage": "interest_coverage",
    "Debt_to_Equity": "debt_to_equity",
    "Operating_Margin": "operating_margin",
}
NEAR_FEATURES = ["sales", "interest", "borrowings", "reserves", "net_profit"]


def rows_with_folds(spark, d) -> DataFrame:
    """Labelled filings with a row id and company-wise folds, written once."""
    df = tables.labelled(spark, d).withColumn("row_id", F.concat_ws("|", "company", "year"))
    return materialise(splitting.group_split(df), "folds")


def _fit(spark, d, name: str, balance: str | None = None):
    train, test = training.fold_parts(rows_with_folds(spark, d), 0)
    return training.train_model(name, train, FILING_FEATURES, balance=balance, overrides=SMALL.get(name)), test


def _facts(scored: DataFrame, name: str) -> DataFrame:
    """What must hold of any scored test part: all rows there, probabilities that sum to one, more hits than the largest class."""
    whole = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    largest = F.greatest(*[F.count_if(F.col("target") == k) for k in range(4)])
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(whole - 1) < 1e-9).alias("normalised"),
        (F.count_if(F.col("target") == F.col("pred")) > largest).alias("beats_majority"),
    ).select(F.lit(name).alias("model"), "rows", "normalised", "beats_majority")


def train_lr(spark, d):
    model, test = _fit(spark, d, "logistic_regression")
    return _facts(model.score(test), model.name)


def train_rf(spark, d):
    model, test = _fit(spark, d, "random_forest")
    return _facts(model.score(test), model.name)


def train_et_approx(spark, d):
    model, test = _fit(spark, d, "extra_trees")
    return _facts(model.score(test), model.name)


def train_boost(spark, d):
    model, test = _fit(spark, d, "boost_a")
    return _facts(model.score(test), model.name)


def train_gbt(spark, d):
    train, test = training.fold_parts(rows_with_folds(spark, d), 0)
    prepared = training.Prepared.fit(train, FILING_FEATURES)
    fitted = models.one_vs_rest_boosting(rounds=2, depth=4).fit(materialise(prepared.transform(train).select("features", "target"), "train"))
    return _facts(training.score_with(fitted, prepared.transform(test)), "one_vs_rest")


def _cascade(spark, d):
    """The published cascade but for ``rounds``, with engineered features of the filings."""
    train, test = training.fold_parts(rows_with_folds(spark, d), 0)
    return training.train_cascade(train, FILING_FEATURES, rounds=20, terms=FILING_TERMS), test


def train_cascade(spark, d):
    cascade, test = _cascade(spark, d)
    serving = cascade.score(test)
    evaluated = cascade.score(test, threshold=0.5)
    return _facts(serving, "threshold 0.40").unionByName(_facts(evaluated, "threshold 0.50"))


def score_cascade(spark, d):
    """Every test row scored; probabilities sum to one and the gate decides by its threshold."""
    cascade, test = _cascade(spark, d)
    path = scratch_path(spark, "cascade")
    cascade.save(spark, path)
    out = training.Cascade.load(spark, path).score(test)
    whole = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return out.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(whole - 1) < 1e-9).alias("normalised"),
        F.count_if((F.col("pred") == 3) == (F.col("gate") >= 0.40)).alias("gated"),
    )


def _audited(spark, d) -> DataFrame:
    """Labelled filings under the names of the audited layout, with folds."""
    rows = rows_with_folds(spark, d)
    return rows.select("row_id", "company", "year", "target", "fold", *[F.col(c).alias(n) for n, c in LIVE_FEATURES.items()])


def feature_columns(spark, d):
    """What a model may see of the audited filings when the inputs of the rule label are left out."""
    rows = tables.labelled(spark, d).select("company", "year", "target", *[F.col(c).alias(n) for n, c in LIVE_FEATURES.items()])
    names = cleaning.feature_columns(rows, ["company", "year", "target", *RULE_INPUTS])
    return cleaning.missing_report(rows, names)


def train_without_rule_inputs(spark, d):
    """A model that can't just repeat the rule behind its labels."""
    train, test = training.fold_parts(_audited(spark, d), 0)
    columns = cleaning.feature_columns(train, ["row_id", "company", "year", "target", "fold", *RULE_INPUTS])
    model = training.train_model("boost_a", train, columns, overrides=SMALL["boost_a"])
    return _facts(model.score(test), ",".join(columns))


def live_report(spark, d):
    """Statements to vectors, scores, the model's own attributions and reports; one line of facts per report.

    ``exact``: the attributions and the base value add up to the margin of the class explained.
    """
    model = training.train_model("boost_b", _audited(spark, d), list(LIVE_FEATURES), overrides=SMALL["boost_b"])
    statements, features = materialise(tables.statements_long(spark, d), "statements"), list(LIVE_FEATURES)
    reports = live_reports(statements, model, features)
    margins = [f"margin_{k}" for k in range(4)]
    outputs = model.model.margins(model.prepared.transform(st.feature_vector(statements, features))).select("ticker", F.array(*margins).alias("margins"))
    phi = F.aggregate("items", F.lit(0.0), lambda a, i: a + i["phi"])
    base = F.array(*[F.lit(b) for b in base_values(model.model, spark)])
    rows = explained_statements(statements, model, features).join(outputs, "ticker")
    sums = rows.select("ticker", (F.abs(F.get(base, "explained") + phi - F.get("margins", "explained")) < 1e-6).alias("exact"))
    whole = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, v: a + v)
    return reports.join(sums, "ticker").select(
        "ticker",
        "latest_period",
        (F.abs(whole - 100) < 0.03).alias("whole"),
        F.col("prediction").isin(CLASS_NAMES).alias("named"),
        (F.size("risk_factors") + F.size("health_factors") <= POSITIVE_LIMIT + NEGATIVE_LIMIT_HEALTHY).alias("limited"),
        F.size("snapshot").alias("indicators"),
        "exact",
    )


def scenario_scores(spark, d):
    """The what-if presets beside every filing put as a what-if row, scored by the same model."""
    model = training.train_model("boost_b", _audited(spark, d), list(LIVE_FEATURES), overrides=SMALL["boost_b"])
    filings = tables.filings(spark, d).withColumn("equity", F.col("equity_share_capital") + F.col("reserves"))
    given = filings.withColumn("scenario", F.lit("filing")).select("scenario", *[c for c in lookup.presets(spark).columns if c in filings.columns])
    rows = lookup.presets(spark).unionByName(given, allowMissingColumns=True)
    scored = model.score(lookup.scenario_vectors(rows, ["scenario"], list(LIVE_FEATURES)))
    whole = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return scored.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(whole - 1) < 1e-9).alias("normalised"),
        F.count_if((F.col("scenario") == "filing") | ((F.col("pred") == 3) == F.col("scenario").startswith("Healthy"))).alias("plausible"),
    )


def training_results(spark, d):
    """Results of the comparison as rows: averages and classes of each model on the companies held out, and importances of its inputs."""
    train, test = training.fold_parts(rows_with_folds(spark, d), 0)
    fitted = [training.train_model(n, train, FILING_FEATURES, overrides=SMALL.get(n)) for n in ("logistic_regression", "random_forest", "boost_a", "boost_b", "boost_c")]
    predictions = materialise(training.held_out_predictions(fitted, test), "predictions")
    return training.result_table(predictions, fitted)


def grid_search(spark, d):
    """The whole published grid over all folds; the refit uses the best point of the table."""
    rows = rows_with_folds(spark, d)
    best, table, _ = training.grid_search("logistic_regression", rows, FILING_FEATURES)
    top = F.max_by("params", F.struct("macro_f1", -F.col("point")))
    return table.agg(F.count(F.lit(1)).alias("points"), F.min("rows").alias("least_rows"), F.max("rows").alias("most_rows"), (top == str(best)).alias("refit_is_best"))


def spark_grid_search(spark, d):
    """Spark's cross-validator over a pipeline with its own imputer and scaler, on company folds, judged by macro F1."""
    rows = rows_with_folds(spark, d)
    lr = models.logistic_regression(1)
    pipeline = Pipeline(stages=[Preprocess(columns=FILING_FEATURES, scaled=True), lr])
    strengths = models.GRIDS["logistic_regression"]["C"]
    # The penalty is stated for the rows of a training part: four folds of five.
    grid = training.logistic_grid(lr, rows.count() * 4 // 5, strengths)
    fitted = training.spark_grid_search(pipeline, grid, rows)
    found = [(c, bool(0.0 < m <= 1.0), bool(m == max(fitted.avgMetrics))) for c, m in zip(strengths, fitted.avgMetrics)]
    table = spark.createDataFrame(found, "strength double, valid boolean, best boolean")
    return table.agg(F.count(F.lit(1)).alias("points"), F.count_if("valid").alias("valid"), (F.count_if("best") > 0).alias("has_best"))


def grouped_cv(spark, d):
    """Out-of-fold predictions: every row once, its company never in the training part."""
    scored = training.cross_validate("random_forest", rows_with_folds(spark, d), FILING_FEATURES, overrides={"trees": 5, "depth": 5})
    return scored.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("distinct_rows"))


def cv_of_model(spark, d):
    """Every row judged once; the summary's means lie in range and the accuracy beats the largest class."""
    scored = materialise(training.cross_validate("logistic_regression", rows_with_folds(spark, d), FILING_FEATURES), "scored")
    summary = metrics.cv_summary(scored)
    largest = F.greatest(*[F.count_if(F.col("target") == k) for k in range(4)])
    hits = scored.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("distinct_rows"), (F.count_if(F.col("target") == F.col("pred")) > largest).alias("beats_majority"))
    return hits.crossJoin(summary.agg(F.count(F.lit(1)).alias("summaries")))


def imbalance_compare(spark, d):
    """Both models under both ways of balancing, over all folds."""
    names = ["logistic_regression", "random_forest"]
    out = training.compare_balancing(names, rows_with_folds(spark, d), FILING_FEATURES, overrides={"random_forest": FOREST})
    per_fold = metrics.macro_metrics(out, by=["model", "balance", "fold"])
    return per_fold.groupBy("model", "balance").agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("support").cast("bigint").alias("rows"),
        F.min(F.col("macro_f1").between(0, 1)).alias("in_range"),
    )


def smote_counts(spark, d):
    df = tables.labelled(spark, d).withColumn("row_id", F.concat_ws("|", "company", "year"))
    out = smote(df, NEAR_FEATURES, "target", "row_id")
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("rows"), F.count_if("synthetic").alias("synthetic"))


def smote_binary(spark, d):
    df = tables.labelled(spark, d).withColumn("row_id", F.concat_ws("|", "company", "year"))
    df = df.withColumn("healthy", (F.col("target") == 3).cast("int"))
    out = smote(df, NEAR_FEATURES, "healthy", "row_id")
    return out.groupBy("healthy").agg(F.count(F.lit(1)).alias("rows"), F.count_if("synthetic").alias("synthetic"))


def near_rows(spark, d):
    """Distances to the five nearest filings of the same class."""
    df = tables.labelled(spark, d).withColumn("row_id", F.concat_ws("|", "company", "year"))
    near = nearest_points(distinct_points(df, "target", "row_id", NEAR_FEATURES), 5, vectors=False)
    return near.select(F.col("cls").alias("target"), F.col("pid").alias("row_id"), F.col("_rn").alias("rank"), F.round("dist", 6).alias("dist"))


def near_embeddings(spark, d):
    """The same over the embedding vectors, by their label."""
    e = tables.table(spark, d, "embeddings").withColumn("row_id", F.col("vec_id").cast("string"))
    near = nearest_points(distinct_points(e, "label", "row_id", "embedding"), 5, vectors=False)
    return near.select(F.col("cls").alias("label"), F.col("pid").alias("row_id"), F.col("_rn").alias("rank"), F.round("dist", 6).alias("dist"))


def _roundtrip(spark, d, name):
    """Rows whose prediction changes when a model is saved with all its preprocessing and loaded again."""
    model, test = _fit(spark, d, name)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = training.Trained.load(spark, path)
    a = model.score(test).select("row_id", F.col("pred").alias("a"))
    b = again.score(test).select("row_id", F.col("pred").alias("b"))
    return a.join(b, "row_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def model_roundtrip(spark, d):
    return _roundtrip(spark, d, "logistic_regression")


def boost_roundtrip(spark, d):
    return _roundtrip(spark, d, "boost_b")


def score_batch(spark, d):
    """All rows scored by name with two models and their blend."""
    rows = rows_with_folds(spark, d)
    train, _ = training.fold_parts(rows, 0)
    registry = Registry()
    for name in ("logistic_regression", "random_forest"):
        registry.add(name, training.train_model(name, train, FILING_FEATURES, overrides=SMALL.get(name)))
    whole = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    parts = [
        registry.score(n, rows, ["row_id"]).select(F.lit(n).alias("model"), "probs", "pred") for n in registry.models
    ]
    parts.append(
        registry.blend({"logistic_regression": 0.4, "random_forest": 0.6}, rows, "row_id").select(F.lit("blend").alias("model"), "probs", "pred")
    )
    return reduce(DataFrame.unionByName, parts).groupBy("model").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(whole - 1) < 1e-9).alias("normalised"),
        F.count_if(argmax("probs") == F.col("pred")).alias("consistent"),
    )


def model_test_comparison(spark, d):
    """Comparison table of five trained models on the companies held out; accuracies recomputed from the predictions."""
    train, test = training.fold_parts(rows_with_folds(spark, d), 0)
    names = ["logistic_regression", "random_forest", "boost_a", "boost_b", "boost_c"]
    fitted = [training.train_model(n, train, FILING_FEATURES, overrides=SMALL.get(n)) for n in names]
    predictions = materialise(training.held_out_predictions(fitted, test), "predictions")
    compared = metrics.model_comparison(predictions).select("model", "accuracy")
    counted = predictions.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("target") == F.col("pred")).cast("double")).alias("_a"))
    return counted.join(compared, "model").select("model", "rows", (F.abs(F.col("_a") - F.col("accuracy")) < 1e-4).alias("accuracy_agrees"))


def feature_importance(spark, d):
    """Features of the forest with their importances, which sum to one."""
    model, _ = _fit(spark, d, "random_forest")
    table = training.importance_table(spark, model.model.featureImportances.toArray(), FILING_FEATURES, len(FILING_FEATURES))
    return table.agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_is_one"),
        F.count_if(F.col("feature").isin(FILING_FEATURES)).alias("known"),
    )


def _sums(model, data: DataFrame, outputs: DataFrame, base: list[float], name: str) -> DataFrame:
    """How many rows' attributions add up to the model's outputs (``out_<k>``), for all classes."""
    phi = tree_attributions(model, data, ["row_id"], FILING_FEATURES, predicted=None)
    sums = phi.groupBy("row_id").agg(*[F.sum(F.when(F.col("class_id") == k, F.col("phi"))).alias(f"s{k}") for k in range(4)])
    error = reduce(F.greatest, [F.abs(F.col(f"out_{k}") - base[k] - F.col(f"s{k}")) for k in range(4)])
    return outputs.join(sums, "row_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(error < 1e-6).alias("exact")).select(F.lit(name).alias("model"), "rows", "exact")


def tree_attribution_sums(spark, d):
    """Attributions of all classes add up to the margins (boosting) and probabilities (forest), row by row."""
    rows = rows_with_folds(spark, d)
    train, _ = training.fold_parts(rows, 0)
    prepared = training.Prepared.fit(train, FILING_FEATURES)
    vectors = materialise(prepared.transform(train).select("features", "target"), "train")
    data = materialise(prepared.transform(rows).select("row_id", "features"), "vectors")
    boost = SoftmaxBoost(rounds=2, max_depth=4, learning_rate=0.4).fit(vectors)
    forest = models.random_forest(trees=10, depth=6).fit(vectors)
    margins = boost.margins(data).select("row_id", *[F.col(f"margin_{k}").alias(f"out_{k}") for k in range(4)])
    probs = forest.transform(data).withColumn("p", vector_to_array("probability")).select("row_id", *[F.col("p")[k].alias(f"out_{k}") for k in range(4)])
    return _sums(boost, data, margins, base_values(boost, spark), "boosting").unionByName(_sums(forest, data, probs, base_values(forest, spark), "forest"))


def tree_attributions_of_test(spark, d):
    """Ranking of mean absolute attributions for the predicted class on held-out companies: every feature once, in falling order."""
    model, test = _fit(spark, d, "boost_b")
    phi = materialise(explain_scores(model.score(test), model, ["row_id"]), "attributions")
    ranking = attribution_ranking(phi)
    counts = phi.agg(F.countDistinct("row_id").alias("rows"), F.count(F.lit(1)).alias("attributions"))
    return counts.crossJoin(ranking.agg(F.count(F.lit(1)).alias("ranked"), F.countDistinct("feature").alias("features")))


QUERIES = {
    "train_lr": train_lr,
    "train_rf": train_rf,
    "train_et_approx": train_et_approx,
    "train_boost": train_boost,
    "train_gbt": train_gbt,
    "train_cascade": train_cascade,
    "train_without_rule_inputs": train_without_rule_inputs,
    "feature_columns": feature_columns,
    "live_report": live_report,
    "scenario_scores": scenario_scores,
    "training_results": training_results,
    "score_cascade": score_cascade,
    "grid_search": grid_search,
    "spark_grid_search": spark_grid_search,
    "grouped_cv": grouped_cv,
    "cv_of_model": cv_of_model,
    "imbalance_compare": imbalance_compare,
    "smote": smote_counts,
    "smote_binary": smote_binary,
    "near_rows": near_rows,
    "near_embeddings": near_embeddings,
    "model_roundtrip": model_roundtrip,
    "boost_roundtrip": boost_roundtrip,
    "score_batch": score_batch,
    "model_test_comparison": model_test_comparison,
    "feature_importance": feature_importance,
    "tree_attribution_sums": tree_attribution_sums,
    "tree_attributions": tree_attributions_of_test,
}

_near = "+".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in NEAR_FEATURES)
_same = " and ".join(f"a.{c}=b.{c}" for c in NEAR_FEATURES)
_test = f"+ {FOLDS}, s as (select company, year, fold from labelled join folds using (company))"

ORACLES = {
    "smote": with_tables(
        "select target, max(count(*)) over () as rows, max(count(*)) over () - count(*) as synthetic from labelled group by target", "labelled"
    ),
    "smote_binary": with_tables(
        "select healthy, max(count(*)) over () as rows, max(count(*)) over () - count(*) as synthetic from (select cast(target=3 as integer) as healthy from labelled) group by healthy",
        "labelled",
    ),
    "near_rows": with_tables(
        f"""+ p as (select target, {', '.join(NEAR_FEATURES)}, min(company||'|'||year) as row_id from labelled group by all),
        d as (select a.target, a.row_id, sqrt({_near}) as dist, b.row_id as other from p a join p b on a.target=b.target and a.row_id<>b.row_id)
        select target, row_id, cast(rank as integer) as rank, round(dist,6) as dist from (
          select *, row_number() over (partition by row_id order by dist, other) as rank from d) where rank<=5""",
        "labelled",
    ),
    "near_embeddings": """with p as (select label, embedding::double[] as v, min(cast(vec_id as varchar)) as row_id from embeddings group by all),
        d as (select a.label, a.row_id, list_distance(a.v, b.v) as dist, b.row_id as other from p a join p b on a.label=b.label and a.row_id<>b.row_id)
        select label, row_id, cast(rank as integer) as rank, round(dist,6) as dist from (
          select *, row_number() over (partition by row_id order by dist, other) as rank from d) where rank<=5""",
    "model_roundtrip": with_tables(f"{_test} select count(*) as rows, 0::bigint as changed from s where fold=0", "labelled"),
    "boost_roundtrip": with_tables(f"{_test} select count(*) as rows, 0::bigint as changed from s where fold=0", "labelled"),
    "score_cascade": with_tables(
        f"{_test} select count(*) as rows, count(*) as normalised, count(*) as gated from s where fold=0", "labelled"
    ),
    "score_batch": with_tables(
        "select model, count(*) as rows, count(*) as normalised, count(*) as consistent from labelled, (select unnest(['logistic_regression','random_forest','blend']) as model) group by model",
        "labelled",
    ),
    "grouped_cv": with_tables(f"{_test} select fold, count(*) as rows, count(*) as distinct_rows from s group by fold", "labelled"),
    "tree_attribution_sums": with_tables(
        "select model, count(*) as rows, count(*) as exact from labelled, (select unnest(['boosting','forest']) as model) group by model", "labelled"
    ),
    "tree_attributions": with_tables(
        f"{_test} select count(*) as rows, count(*) * {len(FILING_FEATURES)} as attributions, {len(FILING_FEATURES)}::bigint as ranked, {len(FILING_FEATURES)}::bigint as features from s where fold=0",
        "labelled",
    ),
    "grid_search": with_tables(
        "select 4::bigint as points, count(*) as least_rows, count(*) as most_rows, true as refit_is_best from labelled", "labelled"
    ),
    "spark_grid_search": "select 4::bigint as points, 4::bigint as valid, true as has_best",
    "cv_of_model": with_tables(
        "select count(*) as rows, count(distinct company||'|'||year) as distinct_rows, true as beats_majority, 1::bigint as summaries from labelled", "labelled"
    ),
    "imbalance_compare": with_tables(
        f"""{_test} select model, balance, count(distinct fold) as folds, count(*) as rows, true as in_range from s,
        (select unnest(['logistic_regression','random_forest']) as model), (select unnest(['weights','smote']) as balance) group by model, balance""",
        "labelled",
    ),
    "model_test_comparison": with_tables(
        f"""{_test} select model, count(*) as rows, true as accuracy_agrees from s,
        (select unnest(['logistic_regression','random_forest','boost_a','boost_b','boost_c']) as model) where fold=0 group by model""",
        "labelled",
    ),
    "feature_columns": with_tables(
        " union all ".join(
            f"select '{n}' as feature, count(*) filter (where {c} is null) as missing_count, round(count(*) filter (where {c} is null)/count(*)*100, 2) as missing_pct from labelled"
            for n, c in LIVE_FEATURES.items()
            if n not in RULE_INPUTS
        ),
        "labelled",
    ),
    "live_report": with_tables(
        """select ticker, max(period) as latest_period, true as whole, true as named, true as limited, 6 as indicators, true as exact
        from statements_long where statement='income' group by ticker""",
        "statements_long",
    ),
    "scenario_scores": with_tables(
        """select 'filing' as scenario, count(*) as rows, count(*) as normalised, count(*) as plausible from filings union all
        select unnest(["""
        + ", ".join(f"'{p[0]}'" for p in lookup.PRESETS)
        + "]), 1, 1, 1",
        "filings",
    ),
    "feature_importance": f"select {len(FILING_FEATURES)}::bigint as features, true as sum_is_one, {len(FILING_FEATURES)}::bigint as known",
    **{
        q: with_tables(
            f"{_test} select model, count(*) as rows, count(*) as normalised, true as beats_majority from s, (select unnest([{', '.join(repr(n) for n in names)}]) as model) where fold=0 group by model",
            "labelled",
        )
        for q, names in {
            "train_lr": ["logistic_regression"],
            "train_rf": ["random_forest"],
            "train_et_approx": ["extra_trees"],
            "train_boost": ["boost_a"],
            "train_gbt": ["one_vs_rest"],
            "train_cascade": ["threshold 0.40", "threshold 0.50"],
            "train_without_rule_inputs": [",".join(n for n in LIVE_FEATURES if n not in RULE_INPUTS)],
        }.items()
    },
}
