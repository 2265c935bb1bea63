"""Company-wise splits, stratified folds, class weights and the leakage check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from solvens.functions.numeric import round_half_even
from solvens.functions.ordering import digest_bucket, row_numbers, stable_key
from solvens.schemas import CLASS_NAMES
from solvens.session import materialise

CLASSES = list(range(len(CLASS_NAMES)))


def group_class_counts(df: DataFrame, group: str = "company", target: str = "target") -> DataFrame:
    """One row per group with its size and its rows per class, combined before the shuffle."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("size"), *[F.count_if(F.col(target) == k).alias(f"class_{k}") for k in CLASSES]
    )


def snake_fold(position: Column, k: int) -> Column:
    """0..k-1, k-1..0, 0.. : neighbours in size end up in different folds."""
    step = (position - 1) % (2 * k)
    return F.when(step < k, step).otherwise(2 * k - 1 - step).cast("int")


def group_folds(df: DataFrame, group: str = "company", target: str = "target", k: int = 5, seed: int = 42) -> DataFrame:
    """Fold per group: groups are stratified by their most frequent class, dealt out by
    size in snake order, ties broken by a seeded digest.

    Only the group table is ranked, in parallel by (stratum, size, digest).
    """
    counts = group_class_counts(df, group, target)
    most = F.greatest(*[F.col(f"class_{c}") for c in CLASSES])
    stratum = F.coalesce(*[F.when(F.col(f"class_{c}") == most, c) for c in CLASSES])
    keyed = counts.select(
        group,
        "size",
        stratum.alias("stratum"),
        (-F.col("size")).alias("_big"),
        stable_key(group, seed=seed).alias("_key"),
    ).withColumn("_head", digest_bucket(F.col("_key"), 2))
    # One row per group, read several times by the ranking; the rows of ``df`` are scanned once.
    keyed = materialise(keyed, "groups")
    ranked = row_numbers(keyed, ["stratum"], ["_big", "_head"], ["_key", group], "position")
    return ranked.select(group, "stratum", "size", snake_fold(F.col("position"), k).alias("fold"))


def group_split(df: DataFrame, group: str = "company", target: str = "target", k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with its ``fold``; fold 0 is the test part.  No group is in two folds.

    The fold table grows with the number of groups, so it is not forced into a
    broadcast; a group holding very many rows is left to AQE's skew join.
    """
    return df.join(group_folds(df, group, target, k, seed).select(group, "fold"), group)


def stratified_folds(df: DataFrame, keys: list[str], target: str = "target", k: int = 5, seed: int = 42) -> DataFrame:
    """Row-wise folds, balanced inside each class; ``keys`` identify a row.

    Rows of a class are ranked by digest, bucket by bucket, so a class with
    most of the rows is still ranked in parallel.
    """
    keyed = df.withColumn("_key", stable_key(*keys, seed=seed)).withColumn("_head", digest_bucket(F.col("_key")))
    ranked = row_numbers(keyed, [target], ["_head"], ["_key", *keys], "_pos")
    return ranked.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_key", "_head", "_pos")


def is_test(fold="fold", test_fold: int = 0) -> Column:
    return F.col(fold) == test_fold


def leakage_check(df: DataFrame, group: str = "company", fold: str = "fold") -> DataFrame:
    """Number of groups found on both sides; must be 0."""
    per_group = df.groupBy(group).agg(
        F.max(is_test(fold).cast("int")).alias("_test"), F.max((~is_test(fold)).cast("int")).alias("_train")
    )
    return per_group.agg(
        F.count_if(F.col("_train") == 1).alias("train_groups"),
        F.count_if(F.col("_test") == 1).alias("test_groups"),
        F.count_if((F.col("_train") == 1) & (F.col("_test") == 1)).alias("overlap"),
    )


def assert_no_leakage(df: DataFrame, group: str = "company", fold: str = "fold") -> None:
    overlap = leakage_check(df, group, fold).first().overlap
    if overlap:
        raise ValueError(f"{overlap} groups are in both the training and the test part")


def split_summary(df: DataFrame, group: str = "company", fold: str = "fold") -> DataFrame:
    """Rows, share of rows and distinct groups of either part."""
    part = F.when(is_test(fold), F.lit("test")).otherwise(F.lit("train"))
    per_group = df.groupBy(part.alias("part"), group).agg(F.count(F.lit(1)).alias("n"))
    parts = per_group.groupBy("part").agg(F.sum("n").alias("rows"), F.count(group).alias("companies"))
    whole = W.partitionBy(F.lit(1))
    return parts.withColumn("pct", round_half_even(F.col("rows") / F.sum("rows").over(whole) * 100, 1))


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Balanced weights n / (classes * n_class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(1))
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )


def with_class_weights(df: DataFrame, target: str = "target", weight: str = "weight") -> DataFrame:
    # One row per class: a bound on the broadcast side.
    weights = class_weights(df, target).select(target, F.col("weight").alias(weight))
    return df.join(F.broadcast(weights), target)
