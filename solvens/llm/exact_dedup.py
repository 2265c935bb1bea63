"""Exact deduplication by merging sorted runs of digests in binomial rounds.

Every partition reduces its rows to one run: digest, smallest id, count, sorted by
digest.  The runs are then exchanged in rounds.  Runs are numbered in base
``fan``; in round r the ``fan`` runs whose numbers differ in digit r only meet,
and each of them takes over the digests whose own digit r is its number.  After
all rounds every digest has met all its copies, and no task ever holds more than
its share of the digests: there is no last task that holds all of them.
Merging keeps the smallest id and the sum of the counts, and checks that rows of equal
digest agree in length and in a second hash.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` is one space; null counts as
empty.  Rows without an id are counted but stay only if no copy has an id.  Rows that repeat
an id with equal text are all marked as kept; ``deduplicate`` lets one of them through.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.llm.common import columns_of, fresh_name, split_by_keys
from solvens.session import materialise

#: Digests one task should hold at the end.
RUN_ROWS = 50_000
FAN = 4

RUN_SCHEMA = "run long, digest binary, keep_id long, size long, n_bytes long, check long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = normalised(F.col(text_col))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("digest"),
        F.octet_length("_text").cast("long").alias("n_bytes"),
        F.xxhash64("_text").alias("check"),
    )


def _smaller(a, b):
    return b if a is None else a if b is None else min(a, b)


def merge_runs(runs):
    """Multiway merge of runs sorted by digest: one row per digest, smallest id, summed count; copies are verified."""
    last = None
    for row in heapq.merge(*runs, key=lambda r: r[0]):
        if last is not None and last[0] == row[0]:
            if last[3:] != row[3:]:
                raise ValueError(f"different texts share the digest {row[0].hex()}")
            last = (last[0], _smaller(last[1], row[1]), last[2] + row[2], *last[3:])
        else:
            if last is not None:
                yield last
            last = row
    if last is not None:
        yield last


def _rows_to_batch(run: int, rows: list) -> pa.RecordBatch:
    digest, keep, size, n_bytes, check = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array([run] * len(rows), pa.int64()), pa.array(digest, pa.binary()), pa.array(keep, pa.int64())]
        + [pa.array(x, pa.int64()) for x in (size, n_bytes, check)],
        names=["run", "digest", "keep_id", "size", "n_bytes", "check"],
    )


def local_runs(batches):
    """Sorted runs of one partition, one row per digest."""
    number = TaskContext.get().partitionId()
    rows: dict[bytes, tuple] = {}
    for batch in batches:
        for keep, digest, n_bytes, check in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "n_bytes", "check")), strict=True):
            have = rows.get(digest)
            if have is None:
                rows[digest] = (digest, keep, 1, n_bytes, check)
            else:
                rows[digest] = next(merge_runs([[have], [(digest, keep, 1, n_bytes, check)]]))
        if len(rows) >= RUN_ROWS:
            yield _rows_to_batch(number, sorted(rows.values(), key=lambda r: r[0]))
            rows = {}
    if rows:
        yield _rows_to_batch(number, sorted(rows.values(), key=lambda r: r[0]))


def _route(batch: pa.RecordBatch, place: int, rounds: int, fan: int) -> pa.RecordBatch:
    """Rows on their way to round ``place``: ``origin`` is the run they come from, ``run`` the one that takes them over."""
    unit = fan**place
    origin = batch.column("run").to_pylist()
    digits = (int.from_bytes(d[:8], "big") // unit % fan for d in batch.column("digest").to_pylist())
    to = [n % fan**rounds - n // unit % fan * unit + d * unit for n, d in zip(origin, digits, strict=True)]
    return batch.set_column(0, "run", pa.array(to, pa.int64())).append_column("origin", pa.array(origin, pa.int64()))


def merge_all(marks: DataFrame, fan: int = FAN, run_rows: int = RUN_ROWS) -> DataFrame:
    """digest, keep_id, size over all rows of ``marks`` (as ``fingerprints`` gives them)."""
    rounds = max(1, math.ceil(math.log(max(2, marks.count() / run_rows), fan)))
    routed = RUN_SCHEMA + ", origin long"

    def start(batches):
        for batch in local_runs(batches):
            yield _route(batch, 0, rounds, fan)

    def meeting(place: int):
        def meet(key, table):
            by_origin: dict[int, list] = {}
            columns = [table.column(c).to_pylist() for c in ("origin", "digest", "keep_id", "size", "n_bytes", "check")]
            for origin, *row in zip(*columns, strict=True):
                by_origin.setdefault(origin, []).append(tuple(row))
            merged = list(merge_runs([sorted(r, key=lambda x: x[0]) for r in by_origin.values()]))
            batch = _rows_to_batch(key[0].as_py(), merged)
            # Sent on by the same task: one Python worker per task is enough.
            return pa.Table.from_batches([_route(batch, place, rounds, fan) if place < rounds else batch])

        return meet

    runs = marks.mapInArrow(start, routed)
    for place in range(1, rounds + 1):
        runs = runs.groupBy("run").applyInArrow(meeting(place), routed if place < rounds else RUN_SCHEMA)
    return runs.select("digest", "keep_id", "size")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``df``."""
    marks = materialise(fingerprints(df, id_col, text_col), "digests")
    merged = merge_all(marks).withColumnRenamed("digest", "_digest")
    return marks.join(merged, F.col("digest") == F.col("_digest")).select(
        "doc_id",
        "keep_id",
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one of each group of equal texts, with the smallest id."""
    marks = materialise(fingerprints(df, id_col, text_col), "digests")
    mark, own, keep = (fresh_name(df, x) for x in ("_mark", "_digest", "_keep_id"))
    several = merge_all(marks).where("size > 1").select(F.col("digest").alias(own), F.col("keep_id").alias(keep))
    several = materialise(several, "copies")
    marked = df.withColumn(mark, F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)))
    # Only texts that occur more than once have to meet; and only they can repeat an id.
    maybe, alone = split_by_keys(marked, F.col(mark), several.select(own))
    met = maybe.join(several, F.col(mark) == F.col(own), "left")
    staying = met.where(F.col(own).isNotNull() & F.col(id_col).cast("long").eqNullSafe(F.col(keep))).dropDuplicates([own])
    parts = [alone, met.where(F.col(own).isNull()), staying]
    return reduce(DataFrame.unionByName, [p.select(*columns_of(df)) for p in parts])
