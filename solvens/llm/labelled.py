"""A bounded sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def held_out(id_col: str, modulus: int, left_out: int):
    """Whether the row belongs to the part no label is learnt from (false for a null id)."""
    return F.coalesce(remainder(id_col, modulus) == left_out, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, left_out: int, max_rows: int) -> DataFrame:
    """doc_id, text, y (0 or 1) of at most ``max_rows`` labelled rows outside the part left out.

    The rows are those whose ids have the smallest hashes: any partitioning gives the same sample.
    Labels other than 0 and 1 and rows without an id are not used; of repeated labels the largest counts,
    of repeated documents one.  Only ids and labels, ``max_rows`` at most, are sent to all tasks.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", modulus, left_out))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .withColumn("_order", F.xxhash64("_id"))
    )
    share = min(1.0, 1.2 * max_rows / max(1, known.count()))
    # A threshold near the bound first, so that no task sorts more than it has to.
    low = -(2**63) + int(share * (2**64 - 1))
    chosen = known.where(F.col("_order") <= F.lit(min(low, 2**63 - 1))).orderBy("_order").limit(max_rows)
    texts = docs.select(F.col("doc_id"), F.col("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"]).select("doc_id", "text", "y", "_order")
