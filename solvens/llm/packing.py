"""Best-fit packing into bins of several permitted lengths.

Documents are measured in tokens and cut into pieces no longer than the largest bin: all full pieces but the last
are bins of their own.  The rest is dealt into shards by a hash of the id; a shard holds
``SHARD_TOKENS`` tokens on average, and a bin never spans shards, so at most one badly filled bin per shard is lost.

In a shard, pieces are taken from long to short.  A piece goes into the open bin it leaves least room in.  If
none has room, the bin size of least expected cost is opened: the cost of a bin is its length plus
``overhead``; what it would leave unused counts in full unless shorter pieces remain to fill it, and the overhead is
shared by the pieces that the bin will hold.  In the end every bin shrinks to the shortest permitted
length that holds its contents.

Pieces of zero tokens (null and empty texts) are placed too, with length 0, in the shard's last bin.  Nothing is dropped.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvens.session import materialise

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a bin beyond its length, in tokens.
OVERHEAD = 16
#: Tokens of a shard on average.
SHARD_TOKENS = 4_000_000
#: Rows of a shard on average: empty texts have no tokens, but take room too.
SHARD_ROWS = 50_000


def token_count(text: Column) -> Column:
    """Words between runs of white space, and one end mark; 0 for null and for texts without words."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")) + 1).cast("long")


def opening_size(piece: int, lengths: tuple, rest: int, mean: float, overhead: int) -> int:
    """The bin size to open for ``piece``, when ``rest`` tokens in pieces of ``mean`` are still to come."""
    best, least = lengths[-1], None
    for size in lengths:
        if size < piece:
            continue
        fill = min(size - piece, rest)
        pieces = 1 + (fill / mean if mean else 0)
        # What is left of the last gap stays empty: half a piece on average, all of it if nothing is to come.
        waste = size - piece - fill + min(fill, mean / 2)
        cost = (size + overhead + waste) / max(1, piece + fill) + overhead / pieces / max(1, piece)
        if least is None or cost < least:
            best, least = size, cost
    return best


def pack_pieces(pieces: list[tuple], lengths: tuple, overhead: int = OVERHEAD) -> list[tuple[int, list[tuple]]]:
    """Bins (size, pieces) of pieces whose first field is their length."""
    ordered = sorted(pieces, reverse=True)
    rest, left = sum(p[0] for p in ordered), len(ordered)
    free: list[tuple[int, int]] = []  # (room, bin) of open bins, sorted
    bins: list[list] = []
    for piece in ordered:
        n = piece[0]
        rest -= n
        left -= 1
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, own = free.pop(at)
        else:
            room, own = opening_size(n, lengths, rest, rest / left if left else 0, overhead), len(bins)
            bins.append([])
        bins[own].append(piece)
        if room > n:
            bisect.insort(free, (room - n, own))
    out = []
    for own in bins:
        used = sum(p[0] for p in own)
        out.append((next(s for s in lengths if s >= used), own))
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, lengths: tuple = LENGTHS, overhead: int = OVERHEAD, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """shard, bin, bin_size, bin_used, place, doc_id, piece, start, n_tokens: where every piece of every row lies.

    ``start`` is the piece's first token in its document, ``place`` its place in the bin.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    tokens = token_count(F.col("text")) if tokens is None else tokens
    # Numbered as written: rows without an id, and rows that share one, spread over the shards like all others.
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("n"), F.monotonically_increasing_id().alias("row"))
    sized = materialise(sized, "lengths")
    total, count = sized.agg(F.sum("n"), F.count(F.lit(1))).first()
    shards = max(1, -(-(total or 0) // shard_tokens), -(-count // shard_rows))
    full = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / most)).otherwise(0)
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), full.cast("long"))))
    cut = cut.select(
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
        "doc_id",
        "piece",
        (F.col("piece") * most).alias("start"),
        F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_tokens"),
    )

    def run(key, table):
        columns = [table.column(c).to_pylist() for c in ("n_tokens", "doc_id", "piece", "start")]
        rows = []
        pieces = [(n, d is not None, d or 0, p, s) for n, d, p, s in zip(*columns, strict=True)]
        for number, (size, own) in enumerate(pack_pieces(pieces, lengths, overhead)):
            used = sum(p[0] for p in own)
            for place, (n, known, d, p, s) in enumerate(own):
                rows.append((number, size, used, place, d if known else None, p, s, n))
        names = ["bin", "bin_size", "bin_used", "place", "doc_id", "piece", "start", "n_tokens"]
        data = {name: pa.array(x, pa.int64()) for name, x in zip(names, zip(*rows, strict=True), strict=True)}
        return pa.table({"shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), **data})

    schema = "shard long, bin long, bin_size long, bin_used long, place long, doc_id long, piece long, start long, n_tokens long"
    return cut.groupBy("shard").applyInArrow(run, schema)
