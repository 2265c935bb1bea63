"""Helpers shared by the operators: tables, Arrow columns, byte buffers, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of one Arrow batch: texts may be very long, and a batch has to fit into a worker several times.
BATCH_ROWS = 128
#: Bytes hashed at once.
CHUNK_BYTES = 1 << 18

SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read with small Arrow batches in mind."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def add_columns(df: DataFrame, columns: list[str], fields: list[StructField], fn: Callable) -> DataFrame:
    """``df`` with the columns ``fields``, which ``fn(*arrow arrays of columns)`` returns batch by batch.

    Rows stay where they are.  Columns of ``df`` that bear a new name are replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = StructType(kept + fields)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            by_name = dict(zip(batch.schema.names, batch.columns, strict=True))
            made = fn(*(by_name[c] for c in columns))
            arrays = [by_name[f.name] for f in kept] + list(made)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])
        give_back()

    return df.mapInArrow(run, schema)


#: Bits of the map that ``split_by_keys`` sends to all tasks: 4 MiB, whatever the number of keys.
MAP_BITS = 1 << 25
MAP_ROW = 1 << 15


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose ``key`` may be in ``keys`` (one column), and rows whose key isn't there for sure.

    Only the first part has to be shuffled for a join.  The keys' hashes mark bits of a map of fixed size; with very many
    keys the map fills up and lets more rows into the first part, and a join gives the same result.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    own, row, bits = (fresh_name(df, x) for x in ("_place", "_row", "_bits"))
    h = place(F.col("`" + keys.columns[0] + "`"))
    marked = keys.select(F.shiftright(h, 15).alias(row), h.bitwiseAND(F.lit(MAP_ROW - 1)).alias("_at"))
    marked = marked.groupBy(row).agg(F.bitmap_construct_agg("_at").alias(bits))
    looked = df.withColumn(own, place(key))
    looked = looked.withColumn(row, F.shiftright(F.col(own), 15)).join(F.broadcast(marked), row, "left")
    byte = f"cast(conv(hex(substring(`{bits}`, cast(shiftright(`{own}` & {MAP_ROW - 1}, 3) + 1 as int), 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"({byte} >> cast(`{own}` & 7 as int)) & 1 = 1"), F.lit(False))
    return looked.where(hit).select(*columns_of(df)), looked.where(~hit).select(*columns_of(df))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins (n + 1 offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def give_back() -> None:
    """Returns memory that a worker no longer uses to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


SPACE_TABLE = byte_table(SPACES)
#: Everything in ASCII but letters and digits parts words of the looser kind.
LOOSE_TABLE = np.array([b < 128 and not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        values = np.full(max(n, 1024), base, np.uint64)
        values[0] = 1
        have = _powers[int(base)] = np.cumprod(values, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes that are no separators, within a text), and the first word of each text (n + 1)."""
    inside = ~separators[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word of ``data``; ``fold`` counts A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(int(np.searchsorted(ends, starts[at] + CHUNK_BYTES)), at + 1)
        low = int(starts[at])
        piece = data[low : ends[to - 1]]
        piece = LOWER[piece] if fold else piece
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_CODES[piece] * powers(BASE, len(piece)), out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * powers(INVERSE, len(piece))[a] + (b - a).astype(np.uint64))
        at = to
    return out
