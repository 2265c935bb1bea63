"""Classification metrics from counts, and ROC curves from distinct scores.

Every threshold-free metric starts from the (truth, prediction) counts: one
partial aggregation over the rows, sixteen rows afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from solvens.functions.numeric import percent_text, round_half_even
from solvens.functions.ordering import BUCKET, bucket_number, quantile_buckets, running_totals, with_neighbour
from solvens.functions.text import class_name
from solvens.schemas import CLASS_NAMES
from solvens.session import materialise

CLASSES = list(range(len(CLASS_NAMES)))


def ratio0(num: Column, den: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "target", pred: str = "pred") -> DataFrame:
    """Rows: truth, columns: prediction, both over all classes; empty cells are 0."""
    counts = pair_counts(df, truth, pred)
    cells = counts.groupBy("y").agg(*[F.sum(F.when(F.col("p") == k, F.col("n"))).alias(f"pred_{k}") for k in CLASSES])
    rows = df.sparkSession.createDataFrame([(k,) for k in CLASSES], "target int")
    return rows.join(cells, F.col("target") == F.col("y"), "left").select(
        "target", *[F.coalesce(f"pred_{k}", F.lit(0)).cast("bigint").alias(f"pred_{k}") for k in CLASSES]
    )


def accuracy(df: DataFrame, truth: str = "target", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    hits = df.groupBy(*by).agg if by else df.agg
    same = F.count_if(F.col(truth) == F.col(pred))
    return hits((same / F.count(F.lit(1))).alias("accuracy"))


def class_table(df: DataFrame, truth: str, pred: str, by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label seen in truth or prediction."""
    counts = pair_counts(df, truth, pred, by)
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    sums = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    )
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        *by,
        "label",
        ratio0(tp, predicted).alias("precision"),
        ratio0(tp, support).alias("recall"),
        ratio0(2 * tp, support + predicted).alias("f1"),
        "support",
        "tp",
    )


def per_class_metrics(df: DataFrame, truth: str = "target", pred: str = "pred") -> DataFrame:
    return class_table(df, truth, pred).select(
        "label", class_name("label").alias("class_name"), "precision", "recall", "f1", "support"
    )


def _averages() -> list[Column]:
    weight = F.col("support")
    return [
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * weight) / F.sum(weight)).alias("weighted_precision"),
        (F.sum(F.col("recall") * weight) / F.sum(weight)).alias("weighted_recall"),
        (F.sum(F.col("f1") * weight) / F.sum(weight)).alias("weighted_f1"),
        F.sum("support").alias("support"),
    ]


def macro_metrics(df: DataFrame, truth: str = "target", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    table = class_table(df, truth, pred, by)
    return table.groupBy(*by).agg(*_averages()) if by else table.agg(*_averages())


def averages_of(table: DataFrame) -> DataFrame:
    """Macro and weighted rows of a per-class table (precision, recall, f1, support)."""
    w = F.col("support")
    both = table.agg(
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
        F.sum(w).alias("support"),
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")],
                F.col("support").cast("double").alias("support"),
            )
            for name, k in (("macro avg", "m"), ("weighted avg", "w"))
        ]
    )
    return both.select(F.inline(rows))


def classification_report(df: DataFrame, truth: str = "target", pred: str = "pred") -> DataFrame:
    """Class rows, then accuracy, macro and weighted averages; the accuracy row repeats
    its value in every column."""
    table = class_table(df, truth, pred)
    classes = table.select(
        class_name("label").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support")
    )
    acc = table.agg((F.sum("tp") / F.sum("support")).alias("a")).select(
        F.lit("accuracy").alias("label"), *[F.col("a").alias(c) for c in ("precision", "recall", "f1", "support")]
    )
    return reduce(DataFrame.unionByName, [classes, acc, averages_of(table)])


def cv_summary(df: DataFrame, truth: str = "target", pred: str = "pred", fold: str = "fold", by: list[str] = ()) -> DataFrame:
    """Mean and population deviation of accuracy and macro F1 over folds, per ``by`` if given."""
    folds = macro_metrics(df, truth, pred, [*by, fold])
    return folds.groupBy(*by).agg(
        F.avg("accuracy").alias("mean_accuracy"),
        F.stddev_pop("accuracy").alias("std_accuracy"),
        F.avg("macro_f1").alias("mean_macro_f1"),
        F.stddev_pop("macro_f1").alias("std_macro_f1"),
    )


def model_comparison(df: DataFrame, model: str = "model", truth: str = "target", pred: str = "pred") -> DataFrame:
    """One row per model: averages and the recall of each class, rounded to 4 places."""
    table = class_table(df, truth, pred, [model])
    recalls = [
        F.coalesce(F.max(F.when(F.col("label") == k, F.col("recall"))), F.lit(0.0)).alias(f"recall_{k}") for k in CLASSES
    ]
    rows = table.groupBy(model).agg(*_averages(), *recalls)
    shown = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", *[f"recall_{k}" for k in CLASSES]]
    return rows.select(model, *[round_half_even(c, 4).alias(c) for c in shown])


def comparison_with_cv(comparison: DataFrame, cv: DataFrame, model: str = "model") -> DataFrame:
    """Comparison rows with the mean cross-validation scores of the same models."""
    means = cv.select(
        model,
        round_half_even("mean_macro_f1", 4).alias("mean_cv_macro_f1"),
        round_half_even("mean_accuracy", 4).alias("mean_cv_accuracy"),
    )
    return comparison.join(means, model, "left")


def model_comparison_percent(df: DataFrame, model: str = "model", truth: str = "target", pred: str = "pred") -> DataFrame:
    """The short comparison: accuracy and recalls as percent texts, F1 scores as numbers."""
    table = class_table(df, truth, pred, [model])
    recalls = [
        F.coalesce(F.max(F.when(F.col("label") == k, F.col("recall"))), F.lit(0.0)).alias(f"recall_{k}") for k in CLASSES
    ]
    rows = table.groupBy(model).agg(*_averages(), *recalls)
    return rows.select(
        model,
        percent_text("accuracy", 2).alias("accuracy"),
        round_half_even("macro_f1", 4).alias("macro_f1"),
        round_half_even("weighted_f1", 4).alias("weighted_f1"),
        *[percent_text(f"recall_{k}", 1).alias(f"recall_{k}") for k in CLASSES],
    )


def best_models(comparison: DataFrame, order: dict[str, int], metrics=("accuracy", "macro_f1", "recall_0"), model: str = "model") -> DataFrame:
    """Best model per metric; on ties the one that comes first in ``order``."""
    place = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])
    rank = -F.try_element_at(place, F.col(model))
    picked = comparison.agg(
        *[F.max_by(F.struct(F.col(model).alias("m"), F.col(m).alias("v")), F.struct(F.col(m), rank)).alias(m) for m in metrics]
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}.m").alias("model"), F.col(f"{m}.v").alias("value")) for m in metrics]
    return picked.select(F.inline(F.array(*rows)))


# --- ROC -------------------------------------------------------------------


def score_counts(df: DataFrame, probs: list[str], truth: str = "target", by: list[str] = ()) -> DataFrame:
    """Positives and negatives per class and distinct score: rows collapse before the shuffle."""
    rows = [
        F.struct(F.lit(k).alias("class_id"), F.col(p).alias("score"), (F.col(truth) == k).cast("bigint").alias("hit"))
        for k, p in enumerate(probs)
    ]
    return (
        df.select(*by, F.inline(F.array(*rows)))
        .groupBy(*by, "class_id", "score")
        .agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    )


def _cumulated(counts: DataFrame, by: list[str], buckets: int, ahead: bool = False) -> DataFrame:
    """Distinct scores from the highest down with ``cum_pos``, ``cum_neg``, the totals
    and, if asked for, the step to the next score."""
    part = [*by, "class_id"]
    # Read for the totals, the edges and the rows themselves.
    cut = materialise(quantile_buckets(counts.withColumn("rank", -F.col("score")), part, "rank", buckets), "score-order")
    rows = with_neighbour(cut, part, "rank", ["pos", "neg"], ahead=True, buckets=buckets) if ahead else cut
    cum = running_totals(rows, part, "rank", ["pos", "neg"], buckets, base=cut)
    totals = counts.groupBy(*part).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(F.broadcast(totals), part)


def roc_curve(df: DataFrame, probs: list[str], truth: str = "target", by: list[str] = (), drop_collinear: bool = True, buckets: int | None = None) -> DataFrame:
    """ROC points per class, from (0, 0) on; points on a straight line may be left out.

    A point is kept when the step to the next score differs from the step that
    led to it; the first and last score are always kept.
    """
    by = list(by)
    part = [*by, "class_id"]
    # Read several times below; written once instead of scanning the rows again.
    counts = materialise(score_counts(df, probs, truth, by), "score-counts")
    cum = _cumulated(counts, by, buckets or bucket_number(counts.count()), ahead=drop_collinear)
    if drop_collinear:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        cum = cum.filter(F.col("next_pos").isNull() | first | bend)
    points = cum.select(
        *part,
        "score",
        F.col("cum_neg").alias("fp"),
        F.col("cum_pos").alias("tp"),
        ratio0(F.col("cum_neg"), F.col("N")).alias("fpr"),
        ratio0(F.col("cum_pos"), F.col("P")).alias("tpr"),
    )
    starts = counts.select(*part).distinct().select(
        *part,
        F.lit(float("inf")).alias("score"),
        F.lit(0).cast("bigint").alias("fp"),
        F.lit(0).cast("bigint").alias("tp"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(starts)


def roc_auc(df: DataFrame, probs: list[str], truth: str = "target", by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Area per class by the trapezoid rule, summed in whole numbers.

    One step from score to score adds ``neg`` to the width and has the mean
    height ``cum_pos - pos / 2``; twice that is an integer.
    """
    by = list(by)
    counts = materialise(score_counts(df, probs, truth, by), "score-counts")
    cum = _cumulated(counts, by, buckets or bucket_number(counts.count()))
    twice = F.col("neg").cast("decimal(19,0)") * (2 * F.col("cum_pos") - F.col("pos")).cast("decimal(19,0)")
    area = cum.groupBy(*by, "class_id").agg(F.sum(twice).alias("a"), F.max("P").alias("P"), F.max("N").alias("N"))
    full = 2 * F.col("P").cast("double") * F.col("N").cast("double")
    return area.select(*by, "class_id", F.when(full > 0, F.col("a").cast("double") / full).alias("auc"))


def roc_macro(df: DataFrame, probs: list[str], truth: str = "target", by: list[str] = (), drop_collinear: bool = True, buckets: int | None = None) -> DataFrame:
    """Mean of the class curves on the union of their false positive rates, for each combination of ``by`` (models, folds).

    Each class curve is read at every rate by linear interpolation between its
    nearest knots; where a curve rises vertically the upper end counts.  Knots
    outside a bucket come from bucket edges, so no window spans the curve.
    """
    by = list(by)
    points = roc_curve(df, probs, truth, by, drop_collinear=drop_collinear, buckets=buckets)
    points = materialise(points.select(*by, "class_id", "fpr", "tpr"), "roc-points")
    buckets = buckets or bucket_number(points.count())
    knots = points.groupBy(*by, "class_id", "fpr").agg(F.min("tpr").alias("low"), F.max("tpr").alias("high"))
    n, part = len(probs), [*by, "k"]
    spread = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                F.when(F.col("class_id") == k, F.struct("fpr", "low", "high")).alias("knot"),
            )
            for k in range(n)
        ]
    )
    grid = (
        knots.select(*by, "fpr", F.inline(spread))
        .groupBy(*part, "fpr")
        .agg(F.max("knot").alias("knot"))
    )
    # Written before and after its buckets are known, so that the curves are merged once.
    cut = materialise(quantile_buckets(materialise(grid, "roc-grid"), part, "fpr", buckets), "roc-order")
    edges = cut.filter(F.col("knot").isNotNull()).groupBy(*part, BUCKET).agg(
        F.max("knot").alias("last"), F.min("knot").alias("first")
    )
    all_buckets = cut.groupBy(*part, BUCKET).agg(F.lit(1).alias("_b")).join(edges, [*part, BUCKET], "left")
    order = W.partitionBy(*part).orderBy(BUCKET)
    carried = all_buckets.select(
        *part,
        BUCKET,
        F.last("last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    # The next knot is the last one of the opposite order: a frame that runs on to the end would be read anew for every row.
    inside = W.partitionBy(*part, BUCKET).orderBy("fpr").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*part, BUCKET).orderBy(F.col("fpr").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = cut.join(F.broadcast(carried), [*part, BUCKET]).select(
        *part,
        "fpr",
        "knot",
        F.coalesce(F.last("knot", ignorenulls=True).over(inside), F.col("_before")).alias("a"),
        F.coalesce(F.last("knot", ignorenulls=True).over(back), F.col("_after")).alias("b"),
    )
    slope = (F.col("b.low") - F.col("a.high")) / (F.col("b.fpr") - F.col("a.fpr"))
    value = F.when(F.col("knot").isNotNull(), F.col("knot.high")).otherwise(
        F.col("a.high") + slope * (F.col("fpr") - F.col("a.fpr"))
    )
    return near.groupBy(*by, "fpr").agg((F.sum(value) / n).alias("mean_tpr"))


def curve_area(curve: DataFrame, x: str = "fpr", y: str = "mean_tpr", by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """Trapezoid area under one curve with distinct ``x``, or under one for each combination of ``by``."""
    by = list(by)
    curve = materialise(curve.select(*by, x, y), "curve")
    steps = with_neighbour(curve, by, x, [x, y], ahead=False, buckets=buckets or bucket_number(curve.count()))
    width = F.col(x) - F.col(f"prev_{x}")
    return (steps.groupBy(*by) if by else steps).agg(F.sum(width * (F.col(y) + F.col(f"prev_{y}")) / 2).alias("auc"))
