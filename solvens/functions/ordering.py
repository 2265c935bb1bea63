"""Ranks, running totals and neighbours over one long order, spread over tasks.

A window without a fine partition key sorts everything in one task.  Here the
order is cut into buckets first; each bucket is sorted on its own and a small
table of bucket totals (bounded by parts x buckets) supplies what lies before
or after it.  The results equal those of the plain window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

BUCKET = "_bucket"
#: Rows of one bucket on average, beyond the least number of buckets.
BUCKET_ROWS = 250_000
LEAST_BUCKETS = 64


def bucket_number(rows: int) -> int:
    """How many buckets an order of ``rows`` rows is cut into, so that one bucket fits one task at any size."""
    return max(LEAST_BUCKETS, -(-rows // BUCKET_ROWS))


def stable_key(*columns, seed: int = 42) -> Column:
    """Hex digest that orders rows the same way in every engine and on every run."""
    parts = [c if isinstance(c, Column) else F.col(c) for c in columns]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in parts]
    return F.md5(F.concat_ws("|", *texts, F.lit(str(seed))))


def digest_bucket(digest: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of a digest: even buckets in digest order."""
    return F.substring(digest, 1, hex_digits)


def row_numbers(df: DataFrame, part: list[str], levels: list[str], order: list, name: str) -> DataFrame:
    """1-based position of each row inside ``part``.

    ``levels`` are columns forming the leading part of the order (ascending);
    rows are sorted only inside one combination of part and levels.  Each
    level's offsets are summed over its parent only, so no window sees more
    rows than one parent has children.
    """
    counts = df.groupBy(*part, *levels).agg(F.count(F.lit(1)).alias("_n"))
    offsets = None
    for depth in range(1, len(levels) + 1):
        keys = part + levels[:depth]
        level = counts.groupBy(*keys).agg(F.sum("_n").alias("_n")) if depth < len(levels) else counts
        w = (
            W.partitionBy(*part, *levels[: depth - 1])
            .orderBy(levels[depth - 1])
            .rowsBetween(W.unboundedPreceding, -1)
        )
        level = level.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(f"_off{depth}"))
        offsets = level if offsets is None else level.join(offsets, part + levels[: depth - 1])
    base = sum((F.col(f"_off{d}") for d in range(2, len(levels) + 1)), F.col("_off1"))
    inside = W.partitionBy(*part, *levels).orderBy(*order)
    return (
        df.join(offsets, part + levels)
        .withColumn(name, (base + F.row_number().over(inside)).cast("bigint"))
        .drop(*[f"_off{d}" for d in range(1, len(levels) + 1)])
    )


def quantile_buckets(df: DataFrame, part: list[str], order: str, buckets: int = 64) -> DataFrame:
    """Add a bucket number that grows with ``order`` and splits each part about evenly.

    ``part`` must come from a bounded domain (class codes, model names): the
    split table has one row per part and is broadcast.
    """
    if buckets < 2:
        return df.withColumn(BUCKET, F.lit(0))
    qs = [i / buckets for i in range(1, buckets)]
    keys = part or ["_one"]
    rows = df if part else df.withColumn("_one", F.lit(1))
    kind = dict(df.dtypes)[order]
    value = (F.col(order).cast("timestamp") if kind in ("date", "timestamp", "timestamp_ntz") else F.col(order)).cast("double")
    # A sketch ten times finer than the buckets: their sizes differ by a tenth of a bucket or so.
    splits = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, qs, 10 * buckets)).alias("_fine")).collect()
    fine = [np.array(r["_fine"] or [], float) for r in splits]
    spark = df.sparkSession
    # One row per part: a bound on the broadcast side.  Splits are searched a batch at a time, by halving.
    numbers = spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(splits)], T.StructType([*[rows.schema[k] for k in keys], T.StructField("_part", T.IntegerType())]))

    @F.pandas_udf("int")
    def bucket(number: pd.Series, v: pd.Series) -> pd.Series:
        at, x = number.to_numpy(), v.to_numpy(dtype=float)
        out = np.zeros(len(x), np.int32)
        for i in np.unique(at):
            out[at == i] = np.searchsorted(fine[i], x[at == i], side="left")
        return pd.Series(out)

    placed = rows.join(F.broadcast(numbers), keys).withColumn("_cut", bucket("_part", value))
    return placed.withColumn(BUCKET, F.when(F.col(order).isNull(), 0).otherwise(F.col("_cut"))).drop("_part", "_cut", "_one")


def running_totals(df: DataFrame, part: list[str], order: str, sums: list[str], buckets: int = 64, base: DataFrame | None = None) -> DataFrame:
    """Add ``cum_<c>`` for each column of ``sums``; ``order`` is unique inside ``part``.

    ``base`` is the bucketed table ``df`` was made from, if its totals are cheaper to get there.
    """
    cut = df if BUCKET in df.columns else quantile_buckets(df, part, order, buckets)
    per_bucket = (cut if base is None else base).groupBy(*part, BUCKET).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = _whole(part).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *part, BUCKET, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = W.partitionBy(*part, BUCKET).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(offsets), part + [BUCKET])
        .select("*", *[(F.col(f"_o_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in sums])
        .drop(*[f"_o_{c}" for c in sums])
    )


def with_neighbour(df: DataFrame, part: list[str], order: str, columns: list[str], ahead: bool, buckets: int = 64) -> DataFrame:
    """Add ``next_<c>`` (or ``prev_<c>``) from the adjoining row of the whole order."""
    prefix = "next" if ahead else "prev"
    cut = df if BUCKET in df.columns else quantile_buckets(df, part, order, buckets)
    pick = F.min_by if ahead else F.max_by
    edge = cut.groupBy(*part, BUCKET).agg(pick(F.struct(*columns), F.col(order)).alias("_edge"))
    whole = _whole(part).orderBy(BUCKET)
    carried = F.lead("_edge").over(whole) if ahead else F.lag("_edge").over(whole)
    edges = edge.select(*part, BUCKET, carried.alias("_carry"))
    inside = W.partitionBy(*part, BUCKET).orderBy(order)
    step = F.lead if ahead else F.lag
    near = step(F.struct(*columns)).over(inside)
    out = cut.join(F.broadcast(edges), part + [BUCKET]).withColumn("_near", F.coalesce(near, F.col("_carry")))
    return out.select(*df.columns, *[F.col(f"_near.{c}").alias(f"{prefix}_{c}") for c in columns])


def _whole(part: list[str]):
    return W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
