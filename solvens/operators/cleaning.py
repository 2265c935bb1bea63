"""Cleaning of raw filings and reports on their quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from solvens.functions.numeric import col, round_half_even, to_double
from solvens.functions.text import class_code, standard_label
from solvens.schemas import RATIO_COLUMNS


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one source lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def standardize_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    return df.withColumn("Standard_Label", standard_label(label))


def labelled_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Standard_Label").isNotNull())


def unlabelled_count(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("Standard_Label").isNull()).alias("unlabelled"),
        F.count("Standard_Label").alias("labelled"),
    )


def encode_target(df: DataFrame) -> DataFrame:
    return df.withColumn("Target", class_code("Standard_Label"))


def derive_ids(df: DataFrame, folder: str = "Folder_name", feature: str = "Feature_name") -> DataFrame:
    return df.withColumns(
        {
            "Company": F.trim(F.col(folder).cast("string")),
            "Year": F.trim(F.col(feature).cast("string")),
        }
    )


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns in one projection; text that is no number becomes NULL."""
    wanted = set(columns)
    return df.select(*[to_double(c).alias(c) if c in wanted else col(c) for c in df.columns])


def align_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly ``features`` as doubles, NULL where ``df`` has no such column."""
    present = set(df.columns)
    return df.select(
        *[col(k) for k in keep],
        *[(to_double(f) if f in present else F.lit(None).cast("double")).alias(f) for f in features],
    )


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    dropped = set(exclude)
    return [c for c in df.columns if c not in dropped]


def clean_filings(df: DataFrame, ratios: list[str] = RATIO_COLUMNS) -> DataFrame:
    """Raw union to modelling rows: labelled, coded, keyed and numeric."""
    named = derive_ids(encode_target(labelled_only(standardize_labels(df))))
    return coerce_numeric(named, ratios)


# --- duplicates ------------------------------------------------------------


def duplicate_count(df: DataFrame, subset: list[str], name: str = "duplicates") -> DataFrame:
    """Rows beyond the first of each group of equal rows; NULLs are equal."""
    groups = df.groupBy(*[col(c) for c in subset]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def key_duplicate_rows(df: DataFrame, keys: list[str], name: str = "rows_involved") -> DataFrame:
    """All rows whose key occurs more than once, counted from per-key counts."""
    groups = df.groupBy(*[col(c) for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias(name))


def drop_duplicates_keep_first(df: DataFrame, subset: list[str], order: list[Column | str]) -> DataFrame:
    """First row per ``subset`` by ``order``.

    An aggregate, so copies collapse before the shuffle and a group holding a
    third of all rows costs each task one row.
    """
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return df.distinct()
    rank = F.struct(*[o if isinstance(o, Column) else col(o) for o in order])
    first = df.groupBy(*[col(c) for c in subset]).agg(
        F.min_by(F.struct(*[col(c) for c in rest]), rank).alias("_first")
    )
    return first.select(*[F.col(f"_first.`{c}`").alias(c) if c in rest else col(c) for c in df.columns])


# --- quality reports -------------------------------------------------------


def class_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """Count and percent per class, missing labels as their own row."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # One row per class from here on.
    whole = W.partitionBy(F.lit(1))
    return counts.withColumn("pct", round_half_even(F.col("n") / F.sum("n").over(whole) * 100, 2))


def _unpivot_counts(df: DataFrame, columns: list[str], count, extra: list[Column]) -> DataFrame:
    """One pass over all columns, then one output row per column."""
    counted = df.agg(*extra, *[count(col(c)).alias(f"_c{i}") for i, c in enumerate(columns)])
    rows = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("n")) for i, c in enumerate(columns)]
    )
    keep = [e for e in counted.columns if not e.startswith("_c")]
    return counted.select(*keep, F.inline(rows))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _unpivot_counts(df, columns, lambda c: F.count_if(c.isNull()), [F.count(F.lit(1)).alias("_rows")])
    share = F.when(F.col("_rows") > 0, round_half_even(F.col("n") / F.col("_rows") * 100, 2))
    return out.select("feature", F.col("n").alias("missing_count"), share.alias("missing_pct"))


def infinity_report(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _unpivot_counts(df, columns, lambda c: F.count_if(F.abs(c) == F.lit(float("inf"))), [])
    return out.filter("n > 0").select("feature", F.col("n").alias("inf_count"))


def stage_counts(df: DataFrame, stages: dict[str, tuple[Column, int]], unique: dict[str, tuple[str, list[str], int]]) -> DataFrame:
    """Rows and columns of the stages that ``df`` goes through, from one scan and one aggregation.

    ``stages``: how many rows of the stage a row of ``df`` becomes, and the stage's columns.  ``unique``: the stage whose rows
    are reduced to one per key, the keys, and the columns.  All ``unique`` stages share their keys.
    """
    keys = next((k for _, k, _ in unique.values()), [])
    at = {name: f"_n{i}" for i, name in enumerate(stages)}
    groups = df.groupBy(*keys).agg(*[F.sum(n.cast("bigint")).alias(at[name]) for name, (n, _) in stages.items()])
    counted = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in at.values()]
    counted += [F.count_if(F.col(at[of]) > 0).alias(f"_u{i}") for i, (of, _, _) in enumerate(unique.values())]
    rows = [(name, at[name], columns) for name, (_, columns) in stages.items()]
    rows += [(name, f"_u{i}", columns) for i, (name, (_, _, columns)) in enumerate(unique.items())]
    structs = [F.struct(F.lit(n).alias("stage"), F.col(c).alias("rows"), F.lit(w).alias("columns")) for n, c, w in rows]
    return groups.agg(*counted).select(F.inline(F.array(*structs)))
