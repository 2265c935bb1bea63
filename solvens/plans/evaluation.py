"""Splits, folds, weights, metrics, ROC curves and probability arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.functions.arrays import argmax, cascade_class, cascade_probabilities, confidence, one_vs_rest, percent_map, weighted_blend
from solvens.functions.text import class_name
from solvens.operators import cleaning, metrics, splitting
from solvens.plans.base import with_tables
from solvens.sources import tables

PROBS = ["p0", "p1", "p2", "p3"]
MODEL_ORDER = {"nearest": 0, "margin": 1, "constant": 2}


def scored(spark, d) -> DataFrame:
    df = tables.probabilities(spark, d).withColumn("probs", F.array(*PROBS))
    return df.withColumn("pred", argmax("probs"))


def predictions(spark, d) -> DataFrame:
    """Three models' predictions per filing, from one pass."""
    df = tables.labelled(spark, d)
    near = tables.near_centres()
    whole = reduce(lambda a, b: a + b, near)
    margin = F.col("operating_margin")
    models = [
        ("nearest", argmax(F.array(*[n / whole for n in near]))),
        ("margin", F.when(margin < 0, 2).when(margin < 0.3, 1).otherwise(3)),
        ("constant", F.lit(3)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("model"), p.alias("pred")) for n, p in models])
    return df.select("company", "year", "target", F.inline(rows))


def _round(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def group_class_counts(spark, d):
    return splitting.group_class_counts(tables.labelled(spark, d))


def group_folds(spark, d):
    return splitting.group_folds(tables.labelled(spark, d))


def group_split(spark, d):
    split = splitting.group_split(tables.labelled(spark, d))
    return split.groupBy("fold", "target").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("company").alias("companies"))


def split_summary(spark, d):
    return splitting.split_summary(splitting.group_split(tables.labelled(spark, d)))


def leakage_check(spark, d):
    return splitting.leakage_check(splitting.group_split(tables.labelled(spark, d)))


def stratified_kfold(spark, d):
    df = splitting.stratified_folds(tables.labelled(spark, d), ["company", "year"])
    return df.select("company", "year", "target", "fold")


def class_weights(spark, d):
    return splitting.class_weights(tables.labelled(spark, d))


def document_class_weights(spark, d):
    return splitting.class_weights(tables.table(spark, d, "labels"), "quality")


def confusion_matrix(spark, d):
    return metrics.confusion_matrix(scored(spark, d))


def accuracy(spark, d):
    return metrics.accuracy(scored(spark, d))


def per_class_metrics(spark, d):
    return _round(metrics.per_class_metrics(scored(spark, d)), ["precision", "recall", "f1"])


AVERAGES = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]


def macro_metrics(spark, d):
    return _round(metrics.macro_metrics(scored(spark, d)), AVERAGES)


def classification_report(spark, d):
    return _round(metrics.classification_report(scored(spark, d)), ["precision", "recall", "f1", "support"])


def cv_summary(spark, d):
    folds = splitting.stratified_folds(scored(spark, d), ["company", "year"])
    out = metrics.cv_summary(folds)
    return _round(out, out.columns)


def model_comparison(spark, d):
    out = metrics.model_comparison(predictions(spark, d))
    return out


def model_comparison_percent(spark, d):
    return metrics.model_comparison_percent(predictions(spark, d))


def model_comparison_cv(spark, d):
    """The comparison with mean scores over row-wise stratified folds."""
    df = splitting.stratified_folds(predictions(spark, d), ["company", "year", "model"])
    return metrics.comparison_with_cv(metrics.model_comparison(df), metrics.cv_summary(df, by=["model"]))


def best_model(spark, d):
    return metrics.best_models(metrics.model_comparison(predictions(spark, d)), MODEL_ORDER)


def roc_curve(spark, d):
    out = metrics.roc_curve(scored(spark, d), PROBS)
    return out.select("class_id", "fp", "tp", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def roc_curve_full(spark, d):
    out = metrics.roc_curve(scored(spark, d), PROBS, drop_collinear=False)
    return out.select("class_id", "fp", "tp")


def roc_auc(spark, d):
    return _round(metrics.roc_auc(scored(spark, d), PROBS), ["auc"], 9)


def roc_macro(spark, d):
    return metrics.roc_macro(scored(spark, d), PROBS).select(
        F.round("fpr", 9).alias("fpr"), F.round("mean_tpr", 6).alias("mean_tpr")
    )


def roc_macro_auc(spark, d):
    curve = metrics.roc_macro(scored(spark, d), PROBS)
    return metrics.curve_area(curve).select(F.round("auc", 6).alias("auc"))


def roc_macro_auc_by_model(spark, d):
    """Area under the macro curve of two models, one with its classes the wrong way round."""
    df = scored(spark, d)
    models = [("nearest", PROBS), ("reversed", PROBS[::-1])]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(c).alias(p) for p, c in zip(PROBS, own)]) for m, own in models])
    both = df.select("target", F.inline(rows))
    curve = metrics.roc_macro(both, PROBS, by=["model"])
    return metrics.curve_area(curve, by=["model"]).select("model", F.round("auc", 6).alias("auc"))


def argmax_class(spark, d):
    df = scored(spark, d)
    shares = percent_map("probs")
    return df.select(
        "company",
        "year",
        class_name("pred").alias("prediction"),
        confidence("probs").alias("confidence"),
        F.element_at(shares, "Bankrupt").alias("pct_bankrupt"),
        F.element_at(shares, "Healthy").alias("pct_healthy"),
    )


def blend(spark, d):
    df = scored(spark, d)
    parts = {
        "a": F.col("probs"),
        "b": F.reverse("probs"),
        "c": F.transform("probs", lambda p: (p + 0.25) / 2),
        "d": F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)),
    }
    mixed = df.withColumn("mix", weighted_blend(list(parts.values()), [0.35, 0.30, 0.20, 0.15]))
    return mixed.select(
        "company", "year", F.round(F.col("mix")[3], 9).alias("mix_healthy"), argmax("mix").alias("pred")
    )


def cascade_combine(spark, d):
    """Gate and severity shares taken from the probabilities."""
    df = scored(spark, d)
    rest = F.col("p0") + F.col("p1") + F.col("p2")
    df = df.withColumn("severity", F.array(*[F.col(p) / rest for p in PROBS[:3]]))
    mixed = cascade_probabilities("p3", "severity")
    return df.select(
        "company",
        "year",
        cascade_class("p3", "severity").alias("pred"),
        cascade_class("p3", "severity", 0.5).alias("pred_even"),
        F.round(mixed[1], 9).alias("p1_combined"),
        F.round(mixed[3], 9).alias("p3_combined"),
    )


def label_binarize(spark, d):
    y = one_vs_rest("target")
    return tables.labelled(spark, d).select("company", "year", *[y[k].alias(f"is_{k}") for k in range(4)])


def training_summary(spark, d):
    """The summary report as (section, entry, value) rows."""
    df = scored(spark, d)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("company").alias("companies"),
        F.min("year").alias("first"),
        F.max("year").alias("last"),
    )
    overview = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("dataset").alias("section"), F.lit(e).alias("entry"), v.cast("string").alias("value"))
                    for e, v in (
                        ("rows", F.col("rows")),
                        ("companies", F.col("companies")),
                        ("years", F.concat_ws("-", "first", "last")),
                    )
                ]
            )
        )
    )
    classes = cleaning.class_distribution(df).select(
        F.lit("classes").alias("section"), class_name("target").alias("entry"), F.col("n").cast("string").alias("value")
    )
    parts = splitting.split_summary(splitting.group_split(df)).select(
        F.lit("split").alias("section"), F.col("part").alias("entry"), F.col("rows").cast("string").alias("value")
    )
    quality = metrics.best_models(metrics.model_comparison(predictions(spark, d)), MODEL_ORDER).select(
        F.lit("best model").alias("section"), F.col("metric").alias("entry"), F.col("model").alias("value")
    )
    return reduce(DataFrame.unionByName, [overview, classes, parts, quality])


QUERIES = {
    "group_class_counts": group_class_counts,
    "group_folds": group_folds,
    "group_split": group_split,
    "split_summary": split_summary,
    "leakage_check": leakage_check,
    "stratified_kfold": stratified_kfold,
    "class_weights": class_weights,
    "document_class_weights": document_class_weights,
    "confusion_matrix": confusion_matrix,
    "accuracy": accuracy,
    "per_class_metrics": per_class_metrics,
    "macro_metrics": macro_metrics,
    "classification_report": classification_report,
    "cv_summary": cv_summary,
    "model_comparison": model_comparison,
    "model_comparison_percent": model_comparison_percent,
    "model_comparison_cv": model_comparison_cv,
    "best_model": best_model,
    "roc_curve": roc_curve,
    "roc_curve_full": roc_curve_full,
    "roc_auc": roc_auc,
    "roc_macro": roc_macro,
    "roc_macro_auc": roc_macro_auc,
    "roc_macro_auc_by_model": roc_macro_auc_by_model,
    "argmax_class": argmax_class,
    "blend": blend,
    "cascade_combine": cascade_combine,
    "label_binarize": label_binarize,
    "training_summary": training_summary,
}

# --- SQL ---------------------------------------------------------------------

FOLDS = """counts as (
  select company, count(*) as size, count(*) filter (where target=0) as c0, count(*) filter (where target=1) as c1,
         count(*) filter (where target=2) as c2, count(*) filter (where target=3) as c3 from labelled group by company),
strata as (
  select *, case greatest(c0,c1,c2,c3) when c0 then 0 when c1 then 1 when c2 then 2 else 3 end as stratum from counts),
placed as (
  select *, (row_number() over (partition by stratum order by size desc, md5(company||'|42'), company) - 1) % 10 as step from strata),
folds as (select company, stratum, size, cast(case when step<5 then step else 9-step end as integer) as fold from placed)"""

KFOLD = "kfold as (select *, cast((row_number() over (partition by target order by md5(company||'|'||year||'|42'), company, year)-1)%5 as integer) as fold from {t})"

# precision, recall and F1 per label, from a table t(by..., y, p)
CLASS_TABLE = """sides as (select {by} y as label, case when y=p then 1 else 0 end as tp, 1 as support, 0 as predicted from t
  union all select {by} p, 0, 0, 1 from t),
ct as (select {by} label, coalesce(sum(tp)/nullif(sum(predicted),0),0) as precision, coalesce(sum(tp)/nullif(sum(support),0),0) as recall,
  coalesce(2*sum(tp)/nullif(sum(support)+sum(predicted),0),0) as f1, cast(sum(support) as bigint) as support, sum(tp) as tp from sides group by {by} label)"""

AVG_SQL = """sum(tp)/sum(support) as accuracy, avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1) as macro_f1,
  sum(precision*support)/sum(support) as weighted_precision, sum(recall*support)/sum(support) as weighted_recall,
  sum(f1*support)/sum(support) as weighted_f1, cast(sum(support) as bigint) as support"""

MODELS = """models as (
  select company, year, target as y, 'nearest' as model, pred as p from scored
  union all select company, year, target, 'margin', case when operating_margin<0 then 2 when operating_margin<0.3 then 1 else 3 end from labelled
  union all select company, year, target, 'constant', 3 from labelled)"""

COMPARISON = f"""t as (select * from models), {CLASS_TABLE.format(by="model,")},
comparison as (select model, round(sum(tp)/sum(support),4) as accuracy, round(avg(precision),4) as macro_precision, round(avg(recall),4) as macro_recall,
  round(avg(f1),4) as macro_f1, round(sum(f1*support)/sum(support),4) as weighted_f1,
  {", ".join(f"round(coalesce(max(recall) filter (where label={k}),0),4) as recall_{k}" for k in range(4))}
  from ct group by model)"""

BEST = " union all ".join(
    f"select '{m}' as metric, model, {m} as value from (select * from comparison order by {m} desc, case model when 'nearest' then 0 when 'margin' then 1 else 2 end limit 1)"
    for m in ("accuracy", "macro_f1", "recall_0")
)

ROC = """long as (
  select target, 0 as class_id, p0 as score from probs union all select target, 1, p1 from probs
  union all select target, 2, p2 from probs union all select target, 3, p3 from probs),
dist as (select class_id, score, sum(case when target=class_id then 1 else 0 end) as pos, sum(case when target=class_id then 0 else 1 end) as neg
  from long group by class_id, score),
cum as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by class_id) as np, sum(neg) over (partition by class_id) as nn,
  row_number() over w as i, lead(pos) over w as next_pos, lead(neg) over w as next_neg
  from dist window w as (partition by class_id order by score desc)),
kept as (select * from cum where i=1 or next_pos is null or next_pos<>pos or next_neg<>neg),
curve as (
  select class_id, cast(fp as bigint) as fp, cast(tp as bigint) as tp, coalesce(fp/nullif(nn,0),0) as fpr, coalesce(tp/nullif(np,0),0) as tpr from kept
  union all select distinct class_id, 0, 0, 0.0, 0.0 from dist)"""

# Each class curve read at every rate of the union: previous and next knot by position.
MACRO = """knots as (select class_id, fpr, min(tpr) as low, max(tpr) as high from curve group by class_id, fpr),
grid as (select k as class_id, fpr from (select distinct fpr from knots), (select unnest([0,1,2,3]) as k)),
filled as (select g.class_id, g.fpr, n.high,
  last_value(case when n.fpr is not null then {'x': n.fpr, 'y': n.high} end ignore nulls) over (partition by g.class_id order by g.fpr rows between unbounded preceding and current row) as a,
  first_value(case when n.fpr is not null then {'x': n.fpr, 'y': n.low} end ignore nulls) over (partition by g.class_id order by g.fpr rows between current row and unbounded following) as b
  from grid g left join knots n on g.class_id=n.class_id and g.fpr=n.fpr),
macro as (select fpr, sum(case when high is not null then high else a.y + (b.y-a.y)/(b.x-a.x)*(fpr-a.x) end)/4 as mean_tpr from filled group by fpr)"""

MACRO_AREA = "select round(sum((fpr-px)*(mean_tpr+py)/2),6) as auc from (select *, lag(fpr) over (order by fpr) as px, lag(mean_tpr) over (order by fpr) as py from macro)"

T = "+ t as (select target as y, pred as p from scored), "
PCT = "cast(printf('%.2f', {c}*100) as double)"

ORACLES = {
    "group_class_counts": with_tables(
        "select company, count(*) as size, "
        + ", ".join(f"count(*) filter (where target={k}) as class_{k}" for k in range(4))
        + " from labelled group by company",
        "labelled",
    ),
    "group_folds": with_tables(f"+ {FOLDS} select company, stratum, size, fold from folds", "labelled"),
    "group_split": with_tables(
        f"+ {FOLDS} select fold, target, count(*) as rows, count(distinct company) as companies from labelled join folds using (company) group by fold, target",
        "labelled",
    ),
    "split_summary": with_tables(
        f"""+ {FOLDS} select case when fold=0 then 'test' else 'train' end as part, count(*) as rows, count(distinct company) as companies,
        round(count(*)/sum(count(*)) over ()*100,1) as pct from labelled join folds using (company) group by 1""",
        "labelled",
    ),
    "leakage_check": with_tables(
        f"""+ {FOLDS}, s as (select company, fold from labelled join folds using (company))
        select count(distinct company) filter (where fold<>0) as train_groups, count(distinct company) filter (where fold=0) as test_groups,
          (select count(*) from (select company from s where fold=0 intersect select company from s where fold<>0)) as overlap from s""",
        "labelled",
    ),
    "stratified_kfold": with_tables(f"+ {KFOLD.format(t='labelled')} select company, year, target, fold from kfold", "labelled"),
    "class_weights": with_tables(
        "select target, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*)) as weight from labelled group by target",
        "labelled",
    ),
    "document_class_weights": "select quality, count(*) as n, sum(count(*)) over () / (count(*) over () * count(*)) as weight from labels group by quality",
    "confusion_matrix": with_tables(
        "select k as target, "
        + ", ".join(f"count(*) filter (where pred={k} and target is not null) as pred_{k}" for k in range(4))
        + " from (select unnest([0,1,2,3]) as k) left join scored on target=k group by k",
        "probs",
    ),
    "accuracy": with_tables("select avg(case when target=pred then 1.0::double else 0 end) as accuracy from scored", "probs"),
    "per_class_metrics": with_tables(
        T
        + CLASS_TABLE.format(by="")
        + """ select label, case label when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' else 'Healthy' end as class_name,
          round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from ct""",
        "probs",
    ),
    "macro_metrics": with_tables(
        T
        + CLASS_TABLE.format(by="")
        + f", a as (select {AVG_SQL} from ct) select "
        + ", ".join(f"round({c},6) as {c}" for c in AVERAGES)
        + ", support from a",
        "probs",
    ),
    "classification_report": with_tables(
        T
        + CLASS_TABLE.format(by="")
        + f""", a as (select {AVG_SQL} from ct)
        select case label when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' else 'Healthy' end as label,
          round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, cast(support as double) as support from ct
        union all select 'accuracy', round(accuracy,6), round(accuracy,6), round(accuracy,6), round(accuracy,6) from a
        union all select 'macro avg', round(macro_precision,6), round(macro_recall,6), round(macro_f1,6), support from a
        union all select 'weighted avg', round(weighted_precision,6), round(weighted_recall,6), round(weighted_f1,6), support from a""",
        "probs",
    ),
    "cv_summary": with_tables(
        f"+ {KFOLD.format(t='scored')}, t as (select fold, target as y, pred as p from kfold), {CLASS_TABLE.format(by='fold,')}, a as (select fold, {AVG_SQL} from ct group by fold) "
        + """select round(avg(accuracy),6) as mean_accuracy, round(stddev_pop(accuracy),6) as std_accuracy,
          round(avg(macro_f1),6) as mean_macro_f1, round(stddev_pop(macro_f1),6) as std_macro_f1 from a""",
        "probs",
    ),
    "model_comparison": with_tables(f"+ {MODELS}, {COMPARISON} select * from comparison", "probs"),
    "model_comparison_percent": with_tables(
        f"""+ {MODELS}, t as (select * from models), {CLASS_TABLE.format(by="model,")}
        select model, format('{{:.2f}}%',sum(tp)/sum(support)*100) as accuracy, round(avg(f1),4) as macro_f1, round(sum(f1*support)/sum(support),4) as weighted_f1,
        {", ".join(f"format('{{:.1f}}%',coalesce(max(recall) filter (where label={k}),0)*100) as recall_{k}" for k in range(4))} from ct group by model""",
        "probs",
    ),
    "model_comparison_cv": with_tables(
        f"""+ {MODELS}, {COMPARISON},
        folded as (select model, y, p, (row_number() over (partition by y order by md5(company||'|'||year||'|'||model||'|42'), company, year, model)-1)%5 as fold from models),
        {CLASS_TABLE.format(by="model, fold,").replace("from t", "from folded").replace("sides", "sides5").replace("ct as", "ct5 as")},
        per_fold as (select model, fold, sum(tp)/sum(support) as acc, avg(f1) as f1 from ct5 group by model, fold),
        cv as (select model, round(avg(f1),4) as mean_cv_macro_f1, round(avg(acc),4) as mean_cv_accuracy from per_fold group by model)
        select * from comparison left join cv using (model)""",
        "probs",
    ),
    "best_model": with_tables(f"+ {MODELS}, {COMPARISON} {BEST}", "probs"),
    "roc_curve": with_tables(f"+ {ROC} select class_id, fp, tp, round(fpr,9) as fpr, round(tpr,9) as tpr from curve", "probs"),
    "roc_curve_full": with_tables(
        f"+ {ROC} select class_id, cast(fp as bigint) as fp, cast(tp as bigint) as tp from cum union all select distinct class_id, 0, 0 from dist",
        "probs",
    ),
    "roc_auc": with_tables(
        f"+ {ROC} select class_id, round(sum(neg*(tp-pos/2.0::double))/(max(np)::double*max(nn)),9) as auc from cum group by class_id", "probs"
    ),
    "roc_macro": with_tables(f"+ {ROC}, {MACRO} select round(fpr,9) as fpr, round(mean_tpr,6) as mean_tpr from macro", "probs"),
    "roc_macro_auc": with_tables(f"+ {ROC}, {MACRO} {MACRO_AREA}", "probs"),
    "roc_macro_auc_by_model": with_tables(
        f"""+ turned as (select target, p3 as p0, p2 as p1, p1 as p2, p0 as p3 from probs)
        select 'nearest' as model, auc from (with {ROC}, {MACRO} {MACRO_AREA})
        union all select 'reversed', auc from (with {ROC.replace("from probs", "from turned")}, {MACRO} {MACRO_AREA})""",
        "probs",
    ),
    "argmax_class": with_tables(
        f"""select company, year, case pred when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' else 'Healthy' end as prediction,
        {PCT.format(c='greatest(p0,p1,p2,p3)')} as confidence, {PCT.format(c='p0')} as pct_bankrupt, {PCT.format(c='p3')} as pct_healthy from scored""",
        "probs",
    ),
    "blend": with_tables(
        """+ m as (select company, year, p0*0.35+p3*0.30+(p0+0.25)/2*0.20+0.0*0.15 as m0, p1*0.35+p2*0.30+(p1+0.25)/2*0.20+0.0*0.15 as m1,
          p2*0.35+p1*0.30+(p2+0.25)/2*0.20+0.0*0.15 as m2, p3*0.35+p0*0.30+(p3+0.25)/2*0.20+1.0*0.15 as m3 from probs)
        select company, year, round(m3,9) as mix_healthy, case when m0>=m1 and m0>=m2 and m0>=m3 then 0 when m1>=m2 and m1>=m3 then 1 when m2>=m3 then 2 else 3 end as pred from m""",
        "probs",
    ),
    "cascade_combine": with_tables(
        """+ s as (select *, p0/(p0+p1+p2) as s0, p1/(p0+p1+p2) as s1, p2/(p0+p1+p2) as s2 from probs),
        s2 as (select *, case when s0>=s1 and s0>=s2 then 0 when s1>=s2 then 1 else 2 end as sev from s)
        select company, year, case when p3>=0.40 then 3 else sev end as pred, case when p3>=0.5 then 3 else sev end as pred_even,
          round(s1*(1-p3),9) as p1_combined, round(p3,9) as p3_combined from s2""",
        "probs",
    ),
    "label_binarize": with_tables(
        "select company, year, " + ", ".join(f"cast(target={k} as integer) as is_{k}" for k in range(4)) + " from labelled",
        "labelled",
    ),
    "training_summary": with_tables(
        f"""+ {FOLDS}, {MODELS}, {COMPARISON}, best as ({BEST})
        select 'dataset' as section, 'rows' as entry, cast(count(*) as varchar) as value from labelled
        union all select 'dataset', 'companies', cast(count(distinct company) as varchar) from labelled
        union all select 'dataset', 'years', min(year)||'-'||max(year) from labelled
        union all select 'classes', case target when 0 then 'Bankrupt' when 1 then 'Financial Distress' when 2 then 'Probably Bankrupt' else 'Healthy' end, cast(count(*) as varchar) from labelled group by target
        union all select 'split', case when fold=0 then 'test' else 'train' end, cast(count(*) as varchar) from labelled join folds using (company) group by 2
        union all select 'best model', metric, model from best""",
        "probs",
    ),
}
