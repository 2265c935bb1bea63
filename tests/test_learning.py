"""Neighbours, oversampling, boosting, attributions, cascade and model handling."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from solvens.ml import models, training
from solvens.ml.attribution import attribute, base_values, ensemble_leaves, expected_value, saved_nodes, tree_attributions
from solvens.ml.boosting import SoftmaxBoost, SoftmaxBoostModel
from solvens.ml.histogram import HistogramBoost
from solvens.ml.evaluation import MacroF1Evaluator
from solvens.ml.scoring import Registry, explained_statements, live_reports, score_statements
from solvens.operators.features import Terms
from solvens.operators.neighbours import distinct_points, nearest_points, neighbour_slots
from solvens.operators.preprocessing import features_vector
from solvens.operators.resampling import smote
from solvens.schemas import CLASS_NAMES
from solvens.session import scratch_path

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        y = [3, 3, 3, 3, 2, 2, 1, 0][i % 8]
        rows.append((f"r{i}", f"c{i // 6}", y, rng.gauss(y, 0.6), rng.gauss(-y, 1.0), rng.random()))
    # Many copies of one row in the smallest class.
    rows += [(f"copy{i}", "cc", 0, 0.0, 0.0, 0.5) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id string, company string, target int, a double, b double, c double")
    return df.withColumn("fold", F.pmod(F.xxhash64("company"), F.lit(3)).cast("int")).cache()


@pytest.fixture(scope="module")
def vectors(table):
    return features_vector(table, COLUMNS).cache()


@pytest.fixture(scope="module")
def boosted(vectors):
    return SoftmaxBoost(rounds=4, max_depth=3, learning_rate=0.5, checkpoint_interval=2).fit(vectors)


@pytest.mark.parametrize("block, max_pivots", [(2000, 16384), (7, 3)])
def test_neighbours_equal_brute_force(spark, table, block, max_pivots):
    points = distinct_points(table, "target", "row_id", COLUMNS)
    got = {}
    for r in nearest_points(points, 4, block=block, max_pivots=max_pivots).collect():
        got.setdefault((r.cls, r.pid), []).append((r._rn, r.dist))
    rows = points.collect()
    for cls in {r.cls for r in rows}:
        own = [r for r in rows if r.cls == cls]
        x = np.array([r.vec for r in own])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        for r, best in zip(own, np.sort(d, axis=1)[:, :4]):
            assert [v for _, v in sorted(got[(cls, r.pid)])] == pytest.approx(list(best))


def test_copies_are_their_own_neighbours(spark, table):
    slots = neighbour_slots(distinct_points(table, "target", "row_id", COLUMNS), 5)
    copy = slots.filter("mult = 40").first()
    assert [s.dist for s in copy.slots] == [0.0] * 5
    assert slots.filter(F.size("slots") != 5).count() == 0


def test_smote_fills_classes_with_points_on_segments(spark, table):
    out = smote(table, COLUMNS, "target", "row_id")
    counts = {r.target: r["count"] for r in out.groupBy("target").count().collect()}
    assert set(counts.values()) == {300}
    made = [tuple(r) for r in out.filter("synthetic").select("target", *COLUMNS).collect()]
    for cls in (0, 1, 2):
        base = np.array([[r.a, r.b, r.c] for r in table.filter(F.col("target") == cls).collect()])
        for p in [np.array(m[1:]) for m in made if m[0] == cls][:25]:
            a = base[:, None, :]
            d = base[None, :, :] - a
            n = (d**2).sum(-1)
            t = np.clip(np.where(n > 0, ((p - a) * d).sum(-1) / np.where(n > 0, n, 1), 0), 0, 1)
            assert np.sqrt(((a + t[..., None] * d - p) ** 2).sum(-1)).min() < 1e-9
    again = smote(table, COLUMNS, "target", "row_id")
    assert out.exceptAll(again).count() == 0


def test_smote_refuses_tiny_classes(spark):
    df = spark.createDataFrame([("x", 0, 1.0), *[(f"y{i}", 1, float(i)) for i in range(9)]], "row_id string, target int, a double")
    with pytest.raises(ValueError):
        smote(df, ["a"], "target", "row_id")


def test_boosting_learns_and_round_trips(spark, vectors, boosted):
    out = boosted.transform(vectors)
    assert MacroF1Evaluator().evaluate(out) > 0.8
    assert MacroF1Evaluator().isLargerBetter()
    rows = out.select("probs", "pred").collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.probs[r.pred] == max(r.probs) for r in rows)
    path = scratch_path(spark, "model")
    boosted.save(spark, path)
    again = SoftmaxBoostModel.load(spark, path).transform(vectors)
    assert out.select("row_id", "probs").exceptAll(again.select("row_id", "probs")).count() == 0
    assert sum(boosted.feature_importances()) == pytest.approx(1.0)


def test_boosting_rejects_unknown_labels(vectors):
    with pytest.raises(ValueError):
        SoftmaxBoost(rounds=1, classes=3).fit(vectors)


def _tree_value(nodes, known, x, i=0):
    """Expected leaf value when only the features in ``known`` are given."""
    node = nodes[i]
    if node["left"] < 0:
        return node["value"]
    left, right = int(node["left"]), int(node["right"])
    f = int(node["feature"])
    if f in known:
        return _tree_value(nodes, known, x, left if x[f] <= node["threshold"] else right)
    share = nodes[left]["cover"] / node["cover"]
    return share * _tree_value(nodes, known, x, left) + (1 - share) * _tree_value(nodes, known, x, right)


def test_attributions_equal_brute_force_shapley(spark, vectors, boosted):
    nodes = saved_nodes(boosted.ensembles[0], spark)
    trees = [{int(r["id"]): r for r in g.to_dict("records")} for _, g in nodes.groupby("treeID")]
    leaves = ensemble_leaves(nodes)
    base = expected_value(leaves)[0]
    x = np.array([r[0] for r in vectors.select(vector_to_array("features")).limit(12).collect()])
    got = attribute(x, leaves)[:, :, 0]
    p = x.shape[1]
    value = lambda known, row: 0.5 * sum(_tree_value(t, known, row) for t in trees)
    assert base == pytest.approx(value(frozenset(), x[0]))
    for r, row in enumerate(x):
        for i in range(p):
            want = 0.0
            for size in range(p):
                for s in itertools.combinations([j for j in range(p) if j != i], size):
                    w = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
                    want += w * (value({*s, i}, row) - value(set(s), row))
            assert got[r, i] == pytest.approx(want, abs=1e-9)


def test_attributions_add_up(spark, vectors, boosted):
    base = base_values(boosted, spark)
    scored = boosted.margins(boosted.transform(vectors))
    phi = tree_attributions(boosted, scored, ["row_id"], COLUMNS)
    sums = {r.row_id: (r.class_id, r.s) for r in phi.groupBy("row_id", "class_id").agg(F.sum("phi").alias("s")).collect()}
    for r in scored.collect():
        k, s = sums[r.row_id]
        assert k == r.pred and s + base[k] == pytest.approx(r[f"margin_{k}"], abs=1e-9)


def test_cascade_saves_and_scores(spark, table):
    cascade = training.train_cascade(table, COLUMNS, balance="weights", rounds=2, depth=3, step=0.5, terms=TERMS)
    path = scratch_path(spark, "cascade")
    cascade.save(spark, path)
    again = training.Cascade.load(spark, path)
    rows = again.score(table).select("gate", "severity", "probs", "pred").collect()
    for r in rows:
        assert sum(r.probs) == pytest.approx(1.0)
        assert r.pred == (3 if r.gate >= 0.40 else max(range(3), key=lambda i: r.severity[i]))


def test_registry_aligns_and_explains_unknown_names(spark, table):
    model = training.train_model("logistic_regression", table, COLUMNS, overrides={"max_iter": 20})
    registry = Registry().add("lr", model)
    partial = table.drop("c").withColumn("a", F.concat(F.lit('"'), F.col("a").cast("string"), F.lit('"')))
    out = registry.score("lr", partial, ["row_id"])
    assert out.count() == table.count() and out.filter("prediction is null").count() == 0
    with pytest.raises(KeyError):
        registry.score("none", table)


STATEMENT_FEATURES = ["Sales", "Interest_Coverage", "Debt_to_Equity"]


def _live_case(spark):
    import datetime

    rng = random.Random(1)
    train = spark.createDataFrame(
        [(f"r{i}", i % 4, 10.0 * i, (i % 4) - 1.0 + rng.random(), 3.0 - i % 4) for i in range(80)],
        "row_id string, target int, Sales double, Interest_Coverage double, Debt_to_Equity double",
    )
    model = training.train_model("boost_b", train, STATEMENT_FEATURES, overrides={"rounds": 4, "max_depth": 3})
    day = datetime.date(2024, 3, 31)
    rows = [("T", "income", "annual", "Total Revenue", day, 5e9), ("T", "balance", "annual", "Total Debt", day, 1e9)]
    rows += [("U", "income", "annual", "Operating Income", day, -9e9), ("U", "balance", "annual", "Stockholders Equity", day, 1e7)]
    # A ticker without a balance sheet gets no report.
    rows += [("V", "income", "annual", "Total Revenue", day, 1e9)]
    landed = spark.createDataFrame(rows, "ticker string, statement string, freq string, line_item string, period date, value double")
    return model, landed


def test_statements_are_scored_end_to_end(spark):
    model, landed = _live_case(spark)
    assert sorted(r.ticker for r in score_statements(landed, model, STATEMENT_FEATURES).select("ticker").collect()) == ["T", "U"]


def test_live_reports_explain_by_the_scoring_model(spark):
    model, landed = _live_case(spark)
    rows = {r.ticker: r for r in explained_statements(landed, model, STATEMENT_FEATURES).collect()}
    scored = model.model.margins(score_statements(landed, model, STATEMENT_FEATURES)).collect()
    base = base_values(model.model, spark)
    assert len(scored) == len(rows) == 2
    for r in scored:
        own = rows[r.ticker]
        assert own.explained == r.pred and [i.feature for i in own["items"]] == STATEMENT_FEATURES
        assert base[r.pred] + sum(i.phi for i in own["items"]) == pytest.approx(r[f"margin_{r.pred}"], abs=1e-9)
    reports = live_reports(landed, model, STATEMENT_FEATURES).collect()
    assert {r.ticker for r in reports} == {"T", "U"}
    for r in reports:
        assert r.prediction in CLASS_NAMES and r.prediction == CLASS_NAMES[rows[r.ticker].explained] and len(r.snapshot) == 6
    assert live_reports(landed.limit(0), model, STATEMENT_FEATURES).count() == 0


TERMS = Terms(quotients={"a_by_b": ("a", "b")}, products={"b_times_c": ("b", "c")})


def test_engineered_terms_reach_the_models(spark, table):
    holes = table.withColumn("a", F.when(F.col("row_id") != "r0", F.col("a")))
    model = training.train_model("boost_b", holes, COLUMNS, overrides={"rounds": 2, "max_depth": 3}, terms=TERMS)
    assert model.prepared.inputs == [*COLUMNS, "num_negative", "num_zero", "mean_ratio", "std_ratio", "median_ratio", "a_by_b", "b_times_c"]
    rows = model.prepared.transform(holes).select("a", "b", "c", vector_to_array("features").alias("x")).limit(50).collect()
    for r in rows:
        v = np.array([r.a, r.b, r.c])
        want = [(v < 0).sum(), (v == 0).sum(), v.mean(), r.x[6], np.median(v), r.a / (abs(r.b) + 1e-4), r.b * r.c]
        assert r.x[3:] == pytest.approx([float(w) for w in want])
    path = scratch_path(spark, "engineered")
    model.save(spark, path)
    again = training.Trained.load(spark, path)
    assert again.prepared.terms == TERMS
    assert model.score(holes).select("row_id", "probs").exceptAll(again.score(holes).select("row_id", "probs")).count() == 0
    scaled = training.Prepared.fit(holes, COLUMNS, scaled=True, terms=TERMS)
    means = scaled.table(holes).agg(*[F.avg(c) for c in scaled.inputs]).first()
    assert list(means) == pytest.approx([0.0] * len(scaled.inputs), abs=1e-9)


def test_rounds_of_a_grid_come_from_one_run(spark, table):
    grid = {"rounds": [1, 3], "max_depth": [2, 3]}
    points = training.grid_points(grid)
    assert training.staged_points("boost_a", points) == [[0, 2], [1, 3]]
    assert training.staged_points("random_forest", points) == [[0], [1], [2], [3]]
    folds = training.prepare_folds("boost_a", table, COLUMNS)
    staged = training.staged_out_of_fold("boost_a", folds, "target", [points[0], points[2]]).cache()
    for stage, p in enumerate([points[0], points[2]]):
        alone = training.out_of_fold("boost_a", folds, "target", p)
        assert staged.filter(F.col("stage") == stage).drop("stage").exceptAll(alone).count() == 0
    best, scores, model = training.grid_search("boost_b", table, COLUMNS, grid)
    got = {r.point: r.macro_f1 for r in scores.collect()}
    assert sorted(got) == [0, 1, 2, 3] and {r.rows for r in scores.collect()} == {table.count()}
    assert best == points[max(got, key=lambda i: (got[i], -i))]
    assert len(model.model.trees[0]) == best["rounds"]


def test_result_table_holds_averages_classes_and_importances(spark, table):
    fitted = [training.train_model(n, table, COLUMNS, overrides=o) for n, o in (("logistic_regression", {"max_iter": 20}), ("random_forest", {"trees": 3, "depth": 3}), ("boost_b", {"rounds": 2, "max_depth": 2}))]
    predictions = training.held_out_predictions(fitted, table)
    rows = training.result_table(predictions, fitted).collect()
    for m in fitted:
        own = [r for r in rows if r.model == m.name]
        assert sum(r.value for r in own if r.section == "importance") == pytest.approx(1.0)
        hits = predictions.filter((F.col("model") == m.name) & (F.col("pred") == F.col("target"))).count()
        assert next(r.value for r in own if r.entry == "accuracy") == pytest.approx(hits / table.count())
        assert sum(r.value for r in own if r.section == "class support") == table.count()


def test_presets_cover_both_runs():
    assert len(models.PRESETS) == 12 and set(models.GRIDS) <= set(models.PRESETS)
    assert sum(models.BLEND_WEIGHTS.values()) == pytest.approx(1.0)
    assert len(training.grid_points(models.GRIDS["random_forest"])) == 16
    for name in models.PRESETS:
        if models.PRESETS[name].kind == "boost":
            assert isinstance(models.build(name, 10), HistogramBoost)
