"""Repeated passages by a hash-compared suffix sort.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else is found; texts are UTF-8 bytes and
matches never cross documents.  A ``Unit`` says what is compared, and how much of it: bytes, or words told by 64-bit hashes, so that
``PASSAGES`` finds every run of more than 50 words that occurs again, whatever its length in bytes and the spaces between.  Sorting all suffixes of a large corpus is out of reach, so a few are chosen in such a way
that none that matters is left out:

1. Each window of ``LENGTH`` bytes has an anchor, the gram of ``GRAM`` bytes with the least hash in it (the last of equals).
   Equal windows have equal anchors at equal places.  A document keeps the anchors of its windows; each of them owns
   a range of windows, and what these windows cover is its context.  Anchors whose gram occurs once in the corpus are done with.
2. Contexts that occur twice or more as a whole repeat in full.  They are told by digests and counted before any text moves.
3. The different contexts of one gram are compared.  Their suffixes (from the anchor on) and their reversed prefixes
   (from the anchor back) are sorted by mergesort; a comparison finds the common extension of two strings by binary
   search over prefix polynomial hashes, so it takes the logarithm of their length.  The bytes of all neighbours are compared
   afterwards: should a hash have collided, the plain order of the bytes is used.
   Contexts that share v bytes before the anchor form ranges of the prefix order; within such a range, neighbours in the suffix order
   share most after it.  Where v and that common prefix add up to ``LENGTH``, the match is covered.
4. A gram with more than ``GROUP`` different contexts doesn't fit a task: there every window is counted by its digest
   in a grouped sum instead, which is exact too.

Only candidate documents move, compressed, and once more when the spans are cut.  Null, empty and short texts have no windows and
stay as they are.  Rows that repeat a text repeat each other, also under one id.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.llm.common import BASE, BYTE_CODES, INVERSE, SPACE_TABLE, columns_of, fresh_name, give_back, mix, powers, split_by_keys, text_bytes, word_bounds, word_hashes
from solvens.session import materialise

LENGTH, GRAM = 400, 64
#: Windows whose anchors are looked for at once.
PIECE = 1 << 20
#: Different contexts of one gram that one task compares, and contexts of a task on average.
GROUP, BUCKET = 16_384, 2_000
#: Members of prefix ranges handled at once.
RANGE_ROWS = 200_000
CODEC, LEVEL = "zstd", 3

LOW_BITS = np.uint64(2**21 - 1)


@dataclass(frozen=True)
class Unit:
    """Repeats of ``length`` cells, found by grams of ``gram``; a cell is a byte of the text or one of its words."""

    length: int = LENGTH
    gram: int = GRAM
    words: bool = False

    @property
    def grams(self) -> int:
        """Grams in a window, and the most windows an anchor owns."""
        return self.length - self.gram + 1

    @property
    def anchor(self) -> int:
        """The column of the anchor in a context as a row."""
        return self.grams - 1

    @property
    def width(self) -> int:
        return self.grams - 1 + self.length

    @property
    def kind(self):
        return np.uint64 if self.words else np.uint8

    @property
    def least_bytes(self) -> int:
        """No shorter text has a window: a word has a byte at least, and a space before the next."""
        return 2 * self.length - 1 if self.words else self.length

    def cells(self, text: np.ndarray) -> np.ndarray:
        return word_hashes(text, *_words(text), fold=False) if self.words else text

    def in_bytes(self, text: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Spans (n, 2) of cells as spans of bytes."""
        if not self.words or not len(spans):
            return spans
        starts, ends = _words(text)
        return np.column_stack([starts[spans[:, 0]], ends[spans[:, 1] - 1]])


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_bounds(text, np.array([0, len(text)]), SPACE_TABLE)[:2]


BYTES = Unit()
GRAMS, WIDTH, ANCHOR = BYTES.grams, BYTES.width, BYTES.anchor
#: More than 50 words.
PASSAGES = Unit(length=51, gram=8, words=True)


def _codes(cells: np.ndarray) -> np.ndarray:
    return BYTE_CODES[cells] if cells.dtype == np.uint8 else cells


def anchors(text: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position and gram hash of each anchor of a text as cells, and the first and last window it owns."""
    out = []
    for a in range(0, len(text) - unit.length + 1, PIECE):
        piece = text[a : a + PIECE + unit.length - 1]
        n = len(piece)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_codes(piece) * powers(BASE, n), out=sums[1:])
        grams = mix((sums[unit.gram :] - sums[: -unit.gram]) * powers(INVERSE, n)[: n - unit.gram + 1])
        # The hash above, the position below: of equal hashes the last position is least.
        low = (grams & ~LOW_BITS) | (LOW_BITS - np.arange(len(grams), dtype=np.uint64))
        span = 1
        while span < unit.grams:
            step = min(span, unit.grams - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        at = (LOW_BITS - (low[first] & LOW_BITS)).astype(np.int64)
        out.append((at + a, grams[at].view(np.int64), first + a, np.r_[first[1:], len(low)] - 1 + a))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(column):
    data, offsets = text_bytes(column)
    return (data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def pack_text(raw: bytes) -> bytes:
    return pa.Codec(CODEC, compression_level=LEVEL).compress(raw, asbytes=True)


def unpack_text(packed: bytes, n_bytes: int) -> np.ndarray:
    if not n_bytes:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.Codec(CODEC).decompress(packed, n_bytes, asbytes=True), np.uint8)


GRAM_ROWS = "unit long, gram long, uid long, n long"


def _grams(units: tuple[Unit, ...]):
    """unit, gram, uid, n: each gram that is an anchor of a document, once a document and unit."""

    def run(batches):
        for batch in batches:
            kinds, keys, owners, counts = [], [], [], []
            for uid, text in zip(batch.column("uid").to_pylist(), _texts(batch.column("text")), strict=True):
                for k, unit in enumerate(units):
                    if len(text) >= unit.least_bytes:
                        own, n = np.unique(anchors(unit.cells(text), unit)[1], return_counts=True)
                        kinds.append(np.full(len(own), k)), keys.append(own), owners.append(np.full(len(own), uid)), counts.append(n)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (kinds, keys, owners, counts)], names=["unit", "gram", "uid", "n"])
        give_back()

    return run


def _packed(batches):
    for batch in batches:
        raw = [t.tobytes() for t in _texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("uid"), pa.array([len(r) for r in raw], pa.int64()), pa.array([pack_text(r) for r in raw], pa.binary())], names=["uid", "n_bytes", "packed"]
        )


def _contexts(text: np.ndarray, wanted: np.ndarray, unit: Unit = BYTES):
    """Position, gram, cells before the anchor, digest and cells (as bytes) of each context of ``text`` whose gram is wanted."""
    at, gram, first, last = anchors(text, unit)
    keep = np.isin(gram, wanted)
    for p, g, s, e in zip(at[keep].tolist(), gram[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
        context = text[s : e + unit.length].tobytes()
        yield p, g, p - s, hashlib.blake2b(context, digest_size=16, salt=(p - s).to_bytes(8, "little")).digest(), context


OCCURRENCES = "uid long, gram long, digest binary, ahead int, size int, places array<int>"


def _occurrences(unit: Unit):
    """Contexts of each document by digest, with the positions of their anchors."""

    def run(batches):
        for batch in batches:
            rows = []
            for uid, n, packed, grams in zip(*(batch.column(c).to_pylist() for c in ("uid", "n_bytes", "packed", "grams")), strict=True):
                found: dict[tuple, tuple] = {}
                for p, gram, ahead, digest, context in _contexts(unit.cells(unpack_text(packed, n)), np.array(grams), unit):
                    found.setdefault((gram, digest), (ahead, len(context) // unit.kind().itemsize, []))[2].append(p)
                rows += [(uid, g, d, a, s, p) for (g, d), (a, s, p) in found.items()]
            if rows:
                uid, gram, digest, ahead, size, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid, pa.int64()), pa.array(gram, pa.int64()), pa.array(digest, pa.binary()), pa.array(ahead, pa.int32()), pa.array(size, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
                    names=["uid", "gram", "digest", "ahead", "size", "places"],
                )

    return run


CONTEXTS = "gram long, digest binary, n long, ahead int, context binary, alone boolean"


def _give(unit: Unit):
    """The bytes of the contexts asked for, from the documents that give them."""

    def run(batches):
        for batch in batches:
            rows = []
            for n_bytes, packed, asked in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "packed", "asked")), strict=True):
                left = {(x["gram"], x["digest"]): (x["n"], x["m"]) for x in asked}
                for _, gram, ahead, digest, context in _contexts(unit.cells(unpack_text(packed, n_bytes)), np.array([g for g, _ in left]), unit):
                    n, m = left.pop((gram, digest), (0, 0))
                    if n:
                        rows.append((gram, digest, n, ahead, context, m > GROUP))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "digest", "n", "ahead", "context", "alone"])

    return run


class Rows:
    """Strings of equal start column as rows of a matrix, with the prefix hashes of each row."""

    def __init__(self, cells: np.ndarray, sizes: np.ndarray):
        self.cells, self.sizes = cells, sizes.astype(np.int64)
        width = cells.shape[1]
        self.sums = np.zeros((len(cells), width + 1), np.uint64)
        np.cumsum(_codes(cells) * powers(BASE, width)[None, :], axis=1, out=self.sums[:, 1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows x and y, by binary search over the hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.sums[x, middle] == self.sums[y, middle]
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def below(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether row x comes before row y, and whether they are equal."""
        n = self.common(x, y)
        x_ends, y_ends = n == self.sizes[x], n == self.sizes[y]
        at = np.minimum(n, self.cells.shape[1] - 1)
        return np.where(x_ends, ~y_ends, ~y_ends & (self.cells[x, at] < self.cells[y, at])), x_ends & y_ends

    def sort(self, segment: np.ndarray) -> np.ndarray:
        """Row numbers ordered by segment, then by string: mergesort of all segments at once, stable."""
        order = np.argsort(segment, kind="stable")
        ordered = segment[order]
        start = np.searchsorted(ordered, ordered)
        size = np.searchsorted(ordered, ordered, side="right") - start
        local = np.arange(len(order)) - start
        width = 1
        while len(size) and width < size.max():
            run = local // width
            other = (run ^ 1) * width
            slot = np.flatnonzero(other < size)
            low = start[slot] + other[slot]
            base, high = low.copy(), start[slot] + np.minimum(other[slot] + width, size[slot])
            second = run[slot] % 2 == 1
            own = order[slot]
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) // 2
                less, equal = self.below(order[middle], own[open_])
                right = less | (equal & second[open_])
                low[open_] = np.where(right, middle + 1, low[open_])
                high[open_] = np.where(right, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            to = start[slot] + (run[slot] // 2) * 2 * width + local[slot] % width + low - base
            order[to] = own
            width *= 2
        return order

    def neighbours(self, order: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, bool]:
        """Common prefix of each row in ``order`` with the one before (-1 at the start of a segment), from
        the bytes themselves; and whether the order is right."""
        out = np.full(len(order), -1, np.int64)
        right = True
        for a in range(1, len(order), 4096):
            x, y = order[a - 1 : a + 4095][: len(order) - a], order[a : a + 4096]
            limit = np.minimum(self.sizes[x], self.sizes[y])
            differ = self.cells[x] != self.cells[y]
            n = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), self.cells.shape[1]), limit)
            same = segment[x] == segment[y]
            at = np.minimum(n, self.cells.shape[1] - 1)
            fine = np.where(n == limit, self.sizes[x] <= self.sizes[y], self.cells[x, at] < self.cells[y, at])
            right &= bool(fine[same].all())
            out[a : a + len(x)] = np.where(same, n, -1)
        return out, right

    def sorted_rows(self, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and neighbours' common prefixes, verified."""
        order = self.sort(segment)
        common, right = self.neighbours(order, segment)
        if not right:  # a hash collided
            keys = [(s, self.cells[i, :n].tobytes()) for i, (s, n) in enumerate(zip(segment.tolist(), self.sizes.tolist(), strict=True))]
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
            common, _ = self.neighbours(order, segment)
        return order, common


def prefix_ranges(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [first, last] of an order whose members share v bytes and that can't be widened, from the neighbours' common prefixes."""
    value, first, last = [], [], []
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*common.tolist()[1:], -1], 1):
        begin = i - 1
        while stack and stack[-1][0] > v:
            own, begin = stack.pop()
            value.append(own), first.append(begin), last.append(i - 1)
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, begin))
    return np.array(value, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def repeats(cells: np.ndarray, ahead: np.ndarray, behind: np.ndarray, gram: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For contexts as rows (anchor at column ``unit.anchor``): how many cells before the anchor, and from it on, repeat (0, 0: none)."""
    after = Rows(cells[:, unit.anchor :], behind)
    before = Rows(cells[:, : unit.anchor][:, ::-1], ahead)
    suffixes, _ = after.sorted_rows(gram)
    rank = np.empty(len(suffixes), np.int64)
    rank[suffixes] = np.arange(len(suffixes))
    prefixes, common = before.sorted_rows(gram)
    value, first, last = prefix_ranges(common)
    to_left, to_right = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    sizes = last - first + 1
    a = 0
    while a < len(sizes):
        b = a + max(1, int(np.searchsorted(np.cumsum(sizes[a:]), RANGE_ROWS)))
        own = np.repeat(np.arange(a, b), sizes[a:b])
        inside = np.arange(len(own)) - np.repeat(np.cumsum(sizes[a:b]) - sizes[a:b], sizes[a:b])
        members = prefixes[first[own] + inside]
        order = np.lexsort((rank[members], own))
        members, own = members[order], own[order]
        pair = np.flatnonzero(own[1:] == own[:-1])
        x, y, v = members[pair], members[pair + 1], value[own[pair]]
        shared = after.common(x, y)
        hit = np.flatnonzero(v + shared >= unit.length)
        for k in range(0, len(hit), 8192):
            h = hit[k : k + 8192]
            column = np.arange(unit.width)[None, :]
            within = (column >= unit.anchor - v[h][:, None]) & (column < unit.anchor + shared[h][:, None])
            wrong = ((cells[x[h]] != cells[y[h]]) & within).any(axis=1)
            for i in h[wrong]:  # a hash collided: count the common cells
                differ = np.flatnonzero(after.cells[x[i]] != after.cells[y[i]])
                shared[i] = min(after.sizes[x[i]], after.sizes[y[i]], *differ[:1])
        hit = hit[v[hit] + shared[hit] >= unit.length]
        for side in (x, y):
            np.maximum.at(to_left, side[hit], v[hit])
            np.maximum.at(to_right, side[hit], shared[hit])
        a = b
    return to_left, to_right


REPEATS = "gram long, digest binary, to_left int, to_right int"


def _compare(unit: Unit):
    """The contexts of the grams of one bucket."""

    def run(key, table):
        contexts = table.column("context").to_pylist()
        ahead = table.column("ahead").to_numpy().astype(np.int64)
        cells = np.zeros((len(contexts), unit.width), unit.kind)
        behind = np.empty(len(contexts), np.int64)
        for i, (a, c) in enumerate(zip(ahead.tolist(), contexts, strict=True)):
            own = np.frombuffer(c, unit.kind)
            cells[i, unit.anchor - a : unit.anchor - a + len(own)] = own
            behind[i] = len(own) - a
        _, gram = np.unique(table.column("gram").to_numpy(), return_inverse=True)
        to_left, to_right = repeats(cells, ahead, behind, gram, unit)
        keep = pa.array(to_right > 0)
        del cells
        give_back()
        return table.select(["gram", "digest"]).append_column("to_left", pa.array(to_left.astype(np.int32))).append_column("to_right", pa.array(to_right.astype(np.int32))).filter(keep)

    return run


def _windows(unit: Unit):
    """gram, digest, back, window, n: every window of a context, ``back`` bytes before the anchor."""

    def run(batches):
        for batch in batches:
            for gram, digest, n, ahead, context in zip(*(batch.column(c).to_pylist() for c in ("gram", "digest", "n", "ahead", "context")), strict=True):
                size = unit.kind().itemsize
                each = len(context) // size - unit.length + 1
                windows = [hashlib.blake2b(context[i * size : (i + unit.length) * size], digest_size=16).digest() for i in range(each)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * each, pa.int64()), pa.array([digest] * each, pa.binary()), pa.array(range(ahead, ahead - each, -1), pa.int32()), pa.array(windows, pa.binary()), pa.array([n] * each, pa.int64())],
                    names=["gram", "digest", "back", "window", "n"],
                )

    return run


def _count_windows(contexts: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """What ``_compare`` finds, for grams of any number of contexts."""
    rows = contexts.mapInArrow(_windows(unit), "gram long, digest binary, back int, window binary, n long")
    twice = rows.groupBy("gram", "window").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("gram").alias("_g"), F.col("window").alias("_w"))
    hit = rows.join(twice, (F.col("gram") == F.col("_g")) & (F.col("window") == F.col("_w")))
    return hit.groupBy("gram", "digest").agg(F.max("back").alias("to_left"), (F.lit(unit.length) - F.min("back")).cast("int").alias("to_right"))


def with_uid(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, doc_id, text; rows of equal id and text share the uid, and all that is found for it."""
    return docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def repeated_spans(rows: DataFrame, units: tuple[Unit, ...] = (BYTES,)) -> tuple[list[DataFrame], DataFrame]:
    """(uid, spans) of the documents of ``rows`` (see ``with_uid``) that hold repeated cells, for each unit, spans as begin and end in cells, any order and
    overlapping; and (uid, n_bytes, packed) of all documents that were looked at closely.  All units share the passes over the texts."""
    long_ = rows.where(F.octet_length("text") >= min(unit.least_bytes for unit in units)).select("uid", "text")
    grams = materialise(long_.mapInArrow(_grams(units), GRAM_ROWS), "grams")
    twice = grams.groupBy("unit", "gram").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("unit").alias("_k"), F.col("gram").alias("_g"))
    # Grams of a document: as many as its length allows.
    wanted = F.array(*(F.collect_set(F.when(F.col("unit") == k, F.col("gram"))) for k in range(len(units))))
    shared = grams.join(twice, (F.col("unit") == F.col("_k")) & (F.col("gram") == F.col("_g")), "left_semi").groupBy("uid").agg(wanted.alias("grams"))
    shared = materialise(shared, "shared")
    near, _ = split_by_keys(long_, F.col("uid"), shared.select("uid"))
    texts = near.mapInArrow(_packed, "uid long, n_bytes long, packed binary").withColumnRenamed("uid", "_u")
    close = materialise(texts.join(shared, F.col("_u") == F.col("uid")).select("uid", "n_bytes", "packed", "grams"), "close")
    one_each = close.dropDuplicates(["uid"]).drop("grams")
    own = (close.withColumn("grams", F.col("grams")[k]).where(F.size("grams") > 0) for k in range(len(units)))
    return [_spans(of, one_each, unit) for of, unit in zip(own, units, strict=True)], one_each


def _spans(close: DataFrame, one_each: DataFrame, unit: Unit) -> DataFrame:
    """(uid, spans) of the documents of ``close`` (uid, n_bytes, packed, grams) by one unit."""
    places = materialise(close.mapInArrow(_occurrences(unit), OCCURRENCES), "places")

    contexts = places.groupBy("gram", "digest").agg(
        F.sum(F.size("places").cast("long")).alias("n"), F.min("uid").alias("giver"), F.max("ahead").alias("ahead"), F.max("size").alias("size")
    )
    contexts = materialise(contexts, "contexts")
    groups = contexts.groupBy(F.col("gram").alias("_g")).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    open_ = contexts.join(groups.where("m > 1 and least = 1"), F.col("gram") == F.col("_g"))
    asked = open_.groupBy(F.col("giver").alias("_u")).agg(F.collect_list(F.struct("gram", "digest", "n", "m")).alias("asked"))
    given = materialise(one_each.join(asked, F.col("uid") == F.col("_u")).select("n_bytes", "packed", "asked").mapInArrow(_give(unit), CONTEXTS), "given")
    buckets = max(1, math.ceil(given.count() / BUCKET))
    compared = given.where("not alone").groupBy(F.pmod("gram", F.lit(buckets)).alias("bucket")).applyInArrow(_compare(unit), REPEATS)
    whole = contexts.where("n > 1").select("gram", "digest", F.col("ahead").alias("to_left"), (F.col("size") - F.col("ahead")).alias("to_right"))
    # A context that occurs twice repeats in full, whatever part of it others share.
    found = whole.unionByName(compared).unionByName(_count_windows(given.where("alone"), unit))
    found = found.groupBy(F.col("gram").alias("_g"), F.col("digest").alias("_d")).agg(F.max("to_left").alias("to_left"), F.max("to_right").alias("to_right"))
    hit = places.join(found, (F.col("gram") == F.col("_g")) & (F.col("digest") == F.col("_d")))
    span = F.transform("places", lambda p: F.struct((p - F.col("to_left")).alias("a"), (p + F.col("to_right")).alias("b")))
    # A set of lists, because a set of spans would compare each with each.
    return hit.select("uid", span.alias("s")).groupBy("uid").agg(F.flatten(F.collect_set("s")).alias("spans"))


def runs(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of spans (n, 2): touching ones are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.r_[True, spans[1:, 0] > reach[:-1]]
    return np.column_stack([spans[first, 0], reach[np.r_[first[1:], True]]])


def kept_mask(n_bytes: int, found: np.ndarray) -> np.ndarray:
    keep = np.ones(n_bytes, bool)
    for a, b in found.tolist():
        keep[a:b] = False
    return keep


CUT = "_u long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(units: tuple[Unit, ...], counted: int):
    """What the first ``counted`` units cut, in numbers and as a digest, and the text that all of them leave."""

    def run(batches):
        for batch in batches:
            rows = []
            for uid, n, packed, spans in zip(*(batch.column(c).to_pylist() for c in ("uid", "n_bytes", "packed", "spans")), strict=True):
                text = unpack_text(packed, n)
                of_units = [np.array([(s["a"], s["b"]) for own in spans if own["unit"] == k for s in own["spans"]], np.int64).reshape(-1, 2) for k in range(len(units))]
                of_units = [unit.in_bytes(text, own) for unit, own in zip(units, of_units, strict=True)]
                found = runs(np.concatenate(of_units[:counted]))
                keep = kept_mask(n, found)
                digest = hashlib.sha256(text[keep].tobytes()).hexdigest()
                keep &= kept_mask(n, runs(np.concatenate(of_units)))
                lead = (text & 0xC0) != 0x80  # a character goes only if all its bytes do
                keep = np.logical_or.reduceat(keep, np.flatnonzero(lead)).repeat(np.diff(np.r_[np.flatnonzero(lead), n])) if n else keep
                rows.append((uid, int((found[:, 1] - found[:, 0]).sum()), len(found), digest, text[keep].tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_u", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _changes(rows: DataFrame, units: tuple[Unit, ...], counted: int) -> DataFrame:
    """What is cut from each document that repeats something by any of ``units``, by ``_u``."""
    found, texts = repeated_spans(rows, units)
    spans = reduce(DataFrame.unionByName, [own.select("uid", F.struct(F.lit(k).alias("unit"), "spans").alias("s")) for k, own in enumerate(found)])
    if len(units) > 1:
        spans = spans.groupBy(F.col("uid").alias("_s")).agg(F.collect_list("s").alias("spans"))
    else:
        spans = spans.select(F.col("uid").alias("_s"), F.array("s").alias("spans"))
    both = spans.join(texts, F.col("_s") == F.col("uid"))
    return both.select("uid", "n_bytes", "packed", "spans").mapInArrow(_cut(units, counted), CUT)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: tuple[Unit, ...] = (BYTES,), besides: tuple[Unit, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text of every row.

    ``text`` is what is left, in whole characters: of a character that is cut in part, all bytes stay.  ``kept_sha256`` is of the bytes left.
    What repeats by ``besides`` is cut out of ``text`` too, but not counted in the columns before it.  Only rows that may have changed move.
    """
    rows = with_uid(docs, id_col, text_col)
    changes = materialise(_changes(rows, units + besides, len(units)), "changes")
    near, rest = split_by_keys(rows, F.col("uid"), changes.select("_u"))
    raw = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")

    def result(part: DataFrame) -> DataFrame:
        return part.select(
            "doc_id",
            F.octet_length(raw).cast("long").alias("n_bytes"),
            F.coalesce("n_removed", none).alias("n_removed"),
            F.coalesce("n_spans", none).alias("n_spans"),
            F.coalesce("kept_sha256", F.sha2(raw, 256)).alias("kept_sha256"),
            F.coalesce(F.col("kept").cast("string"), F.col("text"), F.lit("")).alias("text"),
        )

    unchanged = {f.name: F.lit(None).cast(f.dataType) for f in changes.schema.fields if f.name != "_u"}
    return result(near.join(changes, F.col("uid") == F.col("_u"), "left")).unionByName(result(rest.withColumns(unchanged)))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """``docs`` with what repeats by any of ``units`` cut out of the texts.

    A character goes only if all its bytes are cut.  ``chars_col``, if there is one, becomes the length of texts that changed.
    """
    own, kept = fresh_name(docs, "_u"), fresh_name(docs, "_kept")
    changes = _changes(with_uid(docs, id_col, text_col), units, len(units)).select(F.col("_u").alias(own), F.col("kept").cast("string").alias(kept))
    changes = materialise(changes, "changes")
    uid = F.xxhash64(F.col(id_col), F.col(text_col))
    near, rest = split_by_keys(docs, uid, changes.select(own))
    out = near.join(changes, uid == F.col(own), "left")
    fresh = {text_col: F.coalesce(kept, text_col)}
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        fresh[chars_col] = F.when(F.col(kept).isNotNull(), F.char_length(kept).cast(kind)).otherwise(F.col(chars_col))
    return out.withColumns(fresh).select(*columns_of(docs)).unionByName(rest)
