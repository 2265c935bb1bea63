"""Buckets of a long order: found once, by halving, as before."""

import math

from pyspark.sql import functions as F

from solvens.functions.ordering import BUCKET, quantile_buckets
from solvens.operators import metrics


def test_buckets_grow_with_the_order_and_keep_odd_values(spark):
    rows = [("a", float(i % 50), i) for i in range(500)] + [("b", v, i) for i, v in enumerate([None, math.nan, 1.0, -1.0, math.inf])]
    got = quantile_buckets(spark.createDataFrame(rows, "g string, v double, i int"), ["g"], "v", 8)
    assert got.columns == ["g", "v", "i", BUCKET] and got.count() == 505
    found = {(r.g, r.v): r[BUCKET] for r in got.collect()}
    a = [found["a", float(v)] for v in range(50)]
    assert a == sorted(a) and 7 <= len(set(a)) <= 8
    assert found["b", None] == 0 and found["b", -1.0] <= found["b", 1.0] <= found["b", math.inf]
    assert next(b for (g, v), b in found.items() if v is not None and math.isnan(v)) >= found["b", math.inf]


def test_no_row_is_compared_with_lists_of_splits(spark):
    """Filters over arrays of splits cost most of the time of a curve with millions of scores."""
    df = spark.range(1000).select((F.col("id") % 7).cast("int").alias("target"), *[(F.rand(k) / 4).alias(f"p{k}") for k in range(4)])
    plan = quantile_buckets(df.select("p0"), [], "p0", 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "lambda" not in plan
    # The rows of a curve are placed before they are read several times: nothing of the search is left in its plan.
    assert "bucket(" not in metrics.roc_curve(df, [f"p{k}" for k in range(4)])._jdf.queryExecution().optimizedPlan().toString()


def test_macro_curve_reads_each_bucket_once(spark):
    """A frame from each row to the end of its bucket costs the square of the bucket's rows."""
    df = spark.range(400).select((F.col("id") % 4).cast("int").alias("target"), *[F.rand(k).alias(f"p{k}") for k in range(4)])
    curve = metrics.roc_macro(df, [f"p{k}" for k in range(4)])
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "knot" in line]
    assert rows and not any("currentrow$(), unboundedfollowing$()" in line for line in rows)
    assert curve.count() > 100 and curve.filter("mean_tpr is null").count() == 0
