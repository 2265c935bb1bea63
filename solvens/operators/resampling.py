"""Oversampling of minority classes along lines to near neighbours (Chawla et al. 2002)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.functions.ordering import digest_bucket, row_numbers, stable_key
from solvens.operators.neighbours import distinct_points, neighbour_slots
from solvens.session import materialise


def unit_interval(*columns: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from a hash: the same on every run and after a retry."""
    h = F.xxhash64(*columns, F.lit(seed))
    return F.pmod(h, F.lit(1 << 52)) / F.lit(float(1 << 52))


def class_deficits(df: DataFrame, target: str) -> dict[int, tuple[int, int]]:
    """Class -> (rows, rows missing to the largest class); one row per class on the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    most = max(sizes.values(), default=0)
    return {c: (n, most - n) for c, n in sizes.items()}


def smote(df: DataFrame, features: list[str], target: str, row_id: str, k: int = 5, seed: int = 42, **options) -> DataFrame:
    """Raise every class to the size of the largest.

    Returns target, features and ``synthetic``.  New rows are spread evenly over
    a class's rows, the remainder goes to the first rows by digest.  Each lies
    between a row and one of its ``k`` nearest neighbours of the same class.
    Use on training rows only.
    """
    deficits = {c: v for c, v in class_deficits(df, target).items() if v[1] > 0}
    originals = df.select(target, *[F.col(f"`{f}`").cast("double").alias(f) for f in features], F.lit(False).alias("synthetic"))
    if not deficits:
        return originals
    short = [c for c, (n, _) in deficits.items() if n <= k]
    if short:
        raise ValueError(f"classes {short} have too few rows for {k} neighbours")

    minority = df.filter(F.col(target).isin(list(deficits)))
    keyed = minority.withColumn("_key", stable_key(row_id, seed=seed)).withColumn("_head", digest_bucket(F.col("_key")))
    ranked = row_numbers(keyed.select(target, row_id, *features, "_key", "_head"), [target], ["_head"], ["_key", row_id], "_pos")
    share = F.lit(None)
    for c, (n, missing) in deficits.items():
        extra = (F.col("_pos") <= missing % n).cast("bigint")
        share = F.when(F.col(target) == c, F.lit(missing // n) + extra).otherwise(share)
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    todo = (
        ranked.select(F.col(target).cast("int").alias("cls"), vec.alias("vec"), share.cast("bigint").alias("n"))
        .groupBy("cls", "vec")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0")
    )
    # Points are read several times by the search; neighbours are looked up for bases only.
    points = materialise(distinct_points(minority, target, row_id, features), "points")
    todo = materialise(todo.join(points, ["cls", "vec"]).select("cls", "pid", "n"), "bases")
    bases = todo.join(neighbour_slots(points, k, queries=todo, **options), ["cls", "pid"])

    # A point with very many new rows is cut into runs first, so they spread over tasks.
    run = 1000
    runs = bases.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / run)))).repartition("pid", "run")
    low, high = F.col("run") * run + 1, F.least(F.col("n"), (F.col("run") + 1) * run)
    drawn = runs.withColumn("i", F.explode(F.sequence(low, high)))
    slot = F.pmod(F.xxhash64("pid", "i", F.lit(seed)), F.size("slots")).cast("int")
    u = unit_interval(F.col("pid"), F.col("i"), seed=seed + 1)
    drawn = drawn.withColumns({"u": u, "far": F.element_at("slots", slot + 1)["vec"]})
    made = drawn.select("cls", F.zip_with("vec", "far", lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("ab"), "u")
    synthetic = made.select(
        F.col("cls").cast(dict(df.dtypes)[target]).alias(target),
        *[
            (F.col("ab")[i]["a"] + F.col("u") * (F.col("ab")[i]["b"] - F.col("ab")[i]["a"])).alias(f)
            for i, f in enumerate(features)
        ],
        F.lit(True).alias("synthetic"),
    )
    return originals.unionByName(synthetic)
