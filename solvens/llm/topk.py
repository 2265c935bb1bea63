"""Exact top-k search by distributed histogram selection.

Vectors are turned into whole numbers and packed into blocks of rows.  Query blocks meet candidate blocks; every
score is computed, but only counts leave a task: per query a histogram of the scores in the range that still
holds its k-th value.  The summed histograms narrow every range by a factor of ``BINS``, until it is one value
wide: the exact k-th score.  A last pass lets through the scores above it, and of those equal to it as many as are
missing, smallest ids first.

A task counts only down to its own k-th score: no value below can be the k-th of all.  So a
vector that repeats a million times adds one count per task, and ties add at most k rows per task.

Components that are null or not finite, and null vectors, take their row out.  Where two vectors differ in length,
the components that one lacks count as zero.  Scores are 64-bit integers and wrap as Spark's do.  Rows that repeat an
id are candidates each; a repeated query id is searched once, with the row that is smallest as an array.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvens.llm.common import BATCH_ROWS
from solvens.session import materialise

SCALE = 256
CANDIDATE_ROWS = 1024
QUERY_ROWS = 512
BINS = 256
#: Query blocks whose histograms a task keeps before it gives them out.
OPEN_BLOCKS = 64

BLOCK = "block long, rows int, dim int, kind string, ids binary, cells binary"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and cells (floor(scale * x)) of the rows that take part."""
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v"))
        .where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull())
        .where(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf))))
        .select("vec_id", F.transform("_v", lambda x: F.floor(x.cast("double") * scale)).alias("cells"))
    )


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of ``rows`` vectors each: ids and a matrix in the narrowest type that holds it."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, count = [], 0

        def give():
            nonlocal number
            ids = np.concatenate([h[0] for h in held])
            lists = [x for h in held for x in h[1]]
            dim = max((len(x) for x in lists), default=0)
            cells = np.zeros((len(ids), dim), np.int64)
            for i, x in enumerate(lists):
                cells[i, : len(x)] = x
            kind = next(k for k in ("i2", "i4", "i8") if not cells.size or (cells.min() >= np.iinfo(k).min and cells.max() <= np.iinfo(k).max))
            number += 1
            return pa.RecordBatch.from_pylist(
                [{"block": number, "rows": len(ids), "dim": dim, "kind": kind, "ids": ids.tobytes(), "cells": cells.astype(kind).tobytes()}],
                schema=pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("cells", pa.binary())]),
            )

        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("cells").to_pylist()
            at = 0
            while at < len(ids):
                n = min(rows - count, len(ids) - at)
                held.append((ids[at : at + n], lists[at : at + n]))
                count += n
                at += n
                if count == rows:
                    yield give()
                    held, count = [], 0
        if count:
            yield give()

    return vectors.mapInArrow(run, BLOCK)


def _matrix(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}cells"], row[f"{prefix}kind"]).reshape(len(ids), row[f"{prefix}dim"])


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, all scores of a pair of blocks, and which of them count (not the query's own)."""
    q_ids, q = _matrix(row, "")
    c_ids, c = _matrix(row, "c_")
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    high = [int(np.abs(x.astype(np.float64)).max()) if x.size else 0 for x in (q, c)]
    if dim * high[0] * high[1] < 2**53:
        score = (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        score = q.astype(np.int64) @ c.T.astype(np.int64)
    return q_ids, c_ids, score, q_ids[:, None] != c_ids[None, :]


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _count(span: int, width: int, k: int):
    """Histograms of the scores in ``span`` values from ``low`` up, in bins of ``width``."""

    def run(batches):
        hists: dict[int, np.ndarray] = {}

        def give():
            for block, hist in hists.items():
                # From the top down to the bin in which this task's own count reaches k.
                upto = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]
                query, own = np.nonzero((hist > 0) & (upto - hist < k))
                if len(query):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(query), block)), pa.array(query.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(hist[query, own])],
                        names=["block", "query", "bin", "n"],
                    )
            hists.clear()

        for row in _rows(batches):
            _, _, score, counts = _scores(row)
            low = np.frombuffer(row["low"], np.int64)[:, None]
            inside = counts & (score >= low) & (score < low + span)
            query, column = np.nonzero(inside)
            own = (score[query, column] - low[query, 0]) // width
            hist = np.bincount(query * BINS + own, minlength=len(score) * BINS).reshape(len(score), BINS)
            if row["block"] in hists:
                hists[row["block"]] += hist
            else:
                hists[row["block"]] = hist
            if len(hists) >= OPEN_BLOCKS:
                yield from give()
        yield from give()

    return run


STATE = "block long, low binary, need binary"


def _locate(width: int):
    """Narrows the ranges of one query block: ``low`` of each query and how many of its k are still to be found at or above it."""

    def run(left, right):
        state = left.to_pylist()[0]
        low, need = (np.frombuffer(state[c], np.int64).copy() for c in ("low", "need"))
        hist = np.zeros((len(low), BINS), np.int64)
        query, own = (right.column(c).to_numpy() for c in ("query", "bin"))
        hist[query, own] = right.column("n").to_numpy()
        above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1] - hist
        reached = above + hist >= need[:, None]
        # The highest bin at which the count reaches what is needed; the lowest range if there are fewer.
        at = np.where(reached.any(axis=1), BINS - 1 - np.argmax(reached[:, ::-1], axis=1), 0)
        low += at * width
        need -= above[np.arange(len(low)), at]
        return pa.Table.from_pylist([{"block": state["block"], "low": low.tobytes(), "need": need.tobytes()}], schema=pa.schema([("block", pa.int64()), ("low", pa.binary()), ("need", pa.binary())]))

    return run


def _select(k: int):
    def run(batches):
        for row in _rows(batches):
            q_ids, c_ids, score, counts = _scores(row)
            low, need = (np.frombuffer(row[c], np.int64) for c in ("low", "need"))
            above = counts & (score > low[:, None])
            tied = counts & (score == low[:, None])
            order = np.argsort(c_ids, kind="stable")
            place = np.cumsum(tied[:, order], axis=1)
            tied[:, order] &= place <= need[:, None]
            query, column = np.nonzero(above | tied)
            if len(query):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[query]), pa.array(c_ids[column]), pa.array(score[query, column])], names=["query_id", "vec_id", "score"]
                )

    return run


def top_k(df: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of each query among all other rows, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``; without it every row is a query.
    """
    spark = df.sparkSession
    # Pairs of blocks are wide rows: few of them to a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    vectors = materialise(whole_vectors(df, id_col, vector_col), "vectors")
    queries = (vectors.where(is_query) if is_query is not None else vectors).groupBy("vec_id").agg(F.min("cells").alias("cells"))
    square = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    longest = vectors.agg(F.max(square)).first()[0] or 0.0
    bound = int(min(math.ceil(longest) + 1, 2**62))  # no product of two vectors exceeds the larger square
    candidates = materialise(pack(vectors, CANDIDATE_ROWS).select(*[F.col(c).alias(f"c_{c}") for c in ("ids", "cells", "kind", "dim")]), "candidates")
    packed = materialise(pack(queries, QUERY_ROWS), "queries")

    def start(batches):
        for batch in batches:
            rows = batch.column("rows").to_pylist()
            low = [np.full(n, -bound, np.int64).tobytes() for n in rows]
            need = [np.full(n, k, np.int64).tobytes() for n in rows]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(low, pa.binary()), pa.array(need, pa.binary())], names=["block", "low", "need"])

    state = packed.select("block", "rows").mapInArrow(start, STATE)
    # Widths are powers of BINS: a bin of one round is the whole span of the next, and no score is counted twice.
    span, width = 2 * bound + 1, 1
    while width * BINS < span:
        width *= BINS
    while width:
        pairs = packed.join(state, "block").crossJoin(candidates)
        counted = pairs.mapInArrow(_count(span, width, k), "block long, query int, bin int, n long")
        summed = counted.groupBy("block", "query", "bin").agg(F.sum("n").alias("n"))
        state = materialise(state.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(_locate(width), STATE), "ranges")
        span, width = width, width // BINS
    found = packed.join(state, "block").crossJoin(candidates).mapInArrow(_select(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
