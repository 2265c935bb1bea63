"""Vectors as short codes: a codebook per part of the vector, fitted by member-resident Lloyd rounds.

Components become whole numbers, ``floor(scale * x)``; vectors are cut into ``parts`` equal consecutive parts, and each part position has a codebook
of up to ``entries`` entries, at first that part of the vectors with the smallest ids.  A round assigns every part to its nearest
entry (ties to the lower index) and moves every entry to the floored mean of its parts; unused entries stay.

The parts are resident: they are dealt out once by (position, entry, salt), and the task that owns such a group keeps its members.
From one round to the next the owner compares its members with the new codebook, keeps those whose entry is the same where they are and
sends on only those that changed, in the next shuffle; a union of equally partitioned sets joins both without moving
the residents.  That needs a partitioning which survives a Python step, which DataFrames don't have, so the residents are an RDD of
numpy blocks.  Owners sum their members before anything is gathered: the driver gets one count and sum per entry.

An entry may hold any share of all parts: it has as many salts as its members need at ``GROUP`` parts each, so no task holds it all.  Each
round's residents are checkpointed in ``spark.checkpoint.dir``; the checkpoint keeps the partitioning.

Vectors that are null or hold null or non-finite components take no part.  A vector shorter than the longest, or of a length that can't be cut into equal
parts, counts as filled up with zeros.  Components beyond 64 bits saturate, as do errors.  Rows that repeat an id are rows of their own; of equal ids the smaller vector comes
first.  Rows without an id get codes, but start no entry unless there are too few others.  Fewer vectors than ``entries`` make as many entries.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.llm.common import give_back
from solvens.session import checkpoint_dir, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Members of a (position, entry, salt) group on average, parts of a partition, and parts compared at once.
GROUP, PARTITION, BLOCK = 4_096, 65_536, 4_096
LARGEST = 2**63 - 1

WHOLE = "row long, vec_id long, cells array<long>"
CODED = "row long, vec_id long, code string, error long"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """row (a number of its own for each row), vec_id, label, cells of the vectors that take part."""
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v")).where(F.col("_v").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("_v", lambda x: F.floor(x.cast("double") * scale)).alias("cells"))


@dataclass(frozen=True)
class Shape:
    """How vectors are cut, and whether 64-bit floats hold all sums of products."""

    parts: int
    width: int
    entries: int
    exact: bool
    salts: int

    @property
    def kind(self):
        return np.int64 if self.exact else object

    def matrix(self, lists: pa.Array) -> np.ndarray:
        """(rows, parts, width) of a list column."""
        sizes = np.diff(lists.offsets.to_numpy())
        out = np.zeros((len(lists), self.parts * self.width), np.int64)
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out.reshape(len(lists), self.parts, self.width)

    def nearest(self, cells: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance."""
        kind = np.float64 if self.exact else object
        x, c = cells.astype(kind), book.astype(kind)
        square = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T) if self.width else np.zeros((len(x), len(c)))
        best = np.argmin(square, axis=1)
        return best, square[np.arange(len(x)), best] + (x * x).sum(axis=1)

    def key(self, position: int, entry: np.ndarray, rows: np.ndarray, salts: np.ndarray) -> np.ndarray:
        """The owner group of parts that belong to ``entry``."""
        spread = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        return (position * self.entries + entry) * self.salts + spread % salts[position, entry]

    def place(self, key: int) -> tuple[int, int]:
        return divmod(key // self.salts, self.entries)


def _owner(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 32


def _moved(block) -> bool:
    return not block[1][0]


def _resident(block) -> bool:
    return block[1][0]


def _same(block):
    return block


def _plus(a, b):
    return a[0] + b[0], a[1] + b[1]


def _parts(shape: Shape):
    """Blocks of parts: position, row numbers, cells."""

    def run(batches):
        held, count = [], 0

        def give():
            rows, cells = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            blocks = [np.ascontiguousarray(cells[:, p]).tobytes() for p in range(shape.parts)]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(shape.parts), pa.int32()), pa.array([rows.tobytes()] * shape.parts, pa.binary()), pa.array(blocks, pa.binary())], names=["position", "rows", "cells"]
            )

        for batch in batches:
            matrix = shape.matrix(batch.column("cells"))
            rows = batch.column("row").to_numpy()
            for a in range(0, len(rows), BLOCK):
                held.append((rows[a : a + BLOCK], matrix[a : a + BLOCK]))
                count += len(held[-1][0])
                if count >= BLOCK:
                    yield give()
                    held, count = [], 0
        if count:
            yield give()

    return run


def _cut(keys: np.ndarray, rows: np.ndarray, cells: np.ndarray, resident: bool):
    """A block for each key."""
    order = np.argsort(keys, kind="stable")
    keys, rows, cells = keys[order], rows[order], cells[order]
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(keys[a]), (resident, rows[a:b].copy(), cells[a:b].copy())


def _first(shape: Shape, books: np.ndarray):
    """position, row numbers, cells -> position, entries, row numbers, cells."""

    def run(blocks):
        for position, rows, cells in blocks:
            rows = np.frombuffer(rows, np.int64)
            cells = np.frombuffer(cells, np.int64).reshape(len(rows), shape.width)
            yield position, shape.nearest(cells, books[position])[0], rows, cells

    return run


def _counted(shape: Shape):
    def run(blocks):
        counts = np.zeros((shape.parts, shape.entries), np.int64)
        for position, entry, _, _ in blocks:
            counts[position] += np.bincount(entry, minlength=shape.entries)
        yield counts

    return run


def _dealt(shape: Shape, salts: np.ndarray):
    def run(blocks):
        for position, entry, rows, cells in blocks:
            yield from _cut(shape.key(position, entry, rows, salts), rows, cells, False)

    return run


def _step(shape: Shape, books: np.ndarray, salts: np.ndarray):
    """What an owner does with its residents: those of the same entry stay, the others get the group they move to."""

    def run(blocks):
        held: dict[int, list] = {}
        count = dict.fromkeys(range(shape.parts), 0)

        def compare(position: int):
            keys = np.concatenate([np.full(len(rows), key) for key, rows, _ in held[position]])
            rows, cells = (np.concatenate([h[i] for h in held[position]]) for i in (1, 2))
            held[position], count[position] = [], 0
            entry = shape.nearest(cells, books[position])[0]
            stays = keys // shape.salts == position * shape.entries + entry
            yield from _cut(keys[stays], rows[stays], cells[stays], True)
            goes = ~stays
            yield from _cut(shape.key(position, entry[goes], rows[goes], salts), rows[goes], cells[goes], False)

        for key, (_, rows, cells) in blocks:
            position = shape.place(key)[0]
            held.setdefault(position, []).append((key, rows, cells))
            count[position] += len(rows)
            if count[position] >= BLOCK:
                yield from compare(position)
        for position in range(shape.parts):
            if count[position]:
                yield from compare(position)

    return run


def _sums(shape: Shape):
    """Count and sum of the members of each entry that the partition owns."""

    def run(blocks):
        found: dict[tuple[int, int], tuple] = {}
        for key, (_, rows, cells) in blocks:
            own = len(rows), cells.astype(shape.kind).sum(axis=0)
            place = shape.place(key)
            found[place] = _plus(found[place], own) if place in found else own
        yield from found.items()

    return run


def _updated(books: np.ndarray, state, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after a round, and how many salts each entry needs."""
    books, counts = books.copy(), np.zeros(books.shape[:2], np.int64)
    for (position, entry), (count, total) in state.mapPartitions(_sums(shape)).reduceByKey(_plus).collect():
        counts[position, entry] = count
        books[position, entry] = [int(x) // count for x in total]
    return books, _salts(counts)


def _salts(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-counts // GROUP))


def _shape(vectors: DataFrame, parts: int, entries: int) -> tuple[Shape, int]:
    largest = F.aggregate("cells", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, longest, high = vectors.agg(F.count(F.lit(1)), F.max(F.size("cells")), F.max(largest)).first()
    width = -(-(longest or 0) // parts)
    exact = 4 * max(width, 1) * ((high or 0) + 1) ** 2 < 2**53 and n * ((high or 0) + 1) < 2**62
    return Shape(parts, width, min(entries, n), exact, max(1, -(-n // GROUP))), n


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Shape, np.ndarray]:
    """The codebooks (parts, entries, width) of ``vectors`` (see ``whole_vectors``; a written table)."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    shape, n = _shape(vectors, parts, entries)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "cells").limit(shape.entries).select("cells").toArrow()
    books = shape.matrix(first.column("cells").combine_chunks()).transpose(1, 0, 2).astype(shape.kind) if n else np.zeros((parts, 0, 0), np.int64)
    if not n or not rounds:
        return shape, books
    partitions = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * n // BLOCK + 1), -(-parts * n // PARTITION))
    blocks = vectors.select("row", "cells").mapInArrow(_parts(shape), "position int, rows binary, cells binary").rdd
    assigned = blocks.mapPartitions(_first(shape, books)).persist(StorageLevel.MEMORY_AND_DISK)
    counts = assigned.mapPartitions(_counted(shape)).treeReduce(np.add)
    state = assigned.mapPartitions(_dealt(shape, _salts(counts))).partitionBy(partitions, _owner)
    held = assigned
    for number in range(rounds):
        if number:
            stepped = state.mapPartitions(_step(shape, books, salts), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
            moved = stepped.filter(_moved).map(_same).partitionBy(state.getNumPartitions(), _owner)
            held, state = stepped, stepped.filter(_resident).union(moved)
        state.persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        books, salts = _updated(books, state, shape)
        held.unpersist()
    state.unpersist()
    return shape, books


def _code(shape: Shape, books: np.ndarray):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                own = batch.slice(a, BLOCK)
                matrix = shape.matrix(own.column("cells"))
                codes, errors = np.empty((len(matrix), shape.parts), np.int64), np.zeros(len(matrix), shape.kind)
                for p in range(shape.parts):
                    codes[:, p], error = shape.nearest(matrix[:, p], books[p])
                    errors += error.astype(shape.kind)
                text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [own.column("row"), own.column("vec_id"), pa.array(text, pa.string()), pa.array([min(int(e), LARGEST) for e in errors], pa.int64())], names=["row", "vec_id", "code", "error"]
                )
        give_back()

    return run


def compress(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each vector that takes part."""
    vectors = materialise(whole_vectors(df, id_col, vector_col, label_col, scale), "vectors")
    shape, books = fit(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    coded = vectors.select("row", "vec_id", "cells").mapInArrow(_code(shape, books), CODED)
    coded = materialise(coded.join(vectors.select(F.col("row").alias("_r"), "label"), F.col("row") == F.col("_r")), "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_l")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
