"""Set-similarity join on word n-grams by vertical partitioning.

A document's set holds its distinct shingles; two documents link when the Jaccard similarity of their sets reaches a limit.  All n-grams have
one global order: by hash, with the most frequent ones at the end.  The order is cut into fragments, each document's set into the segments that
lie in them.  Overlaps are counted fragment by fragment, each on its own, and the partial counts are summed per pair.

1. Documents of equal sets are a class, told by a 128-bit digest; classes are joined, not documents.  Blocks of documents count their n-grams; those
   counted ``HOT`` times or more, at most ``HOT_GRAMS``, are the frequent ones.  Which n-grams these are affects the work, never the result.
2. The first fragment differs in length from set to set.  Let o be the least overlap of a pair that links.  Then the first |x| - o + r n-grams
   of x and the first |y| - o + r of y have r or more in common.  The smaller set of a pair is cut by the o of sets of equal size, the larger one by the o of
   its smallest partner.  Pairs are counted in this fragment by grouped sums; those with fewer than r common n-grams are done with.  Frequent n-grams
   are counted only where a set has too few others: a template that all share, or a line on every page, makes no pairs.  Where they are counted,
   only sets join in that can reach the limit by them alone; the others need infrequent n-grams in common besides.
3. Before that, every class that shares half of its first fragment with the head of an n-gram is compared with that one; what links is
   one component from then on.  The head is the class with the least share of n-grams that are not frequent: in a group of near copies, the text they all come from.  Pairs are formed only between components: a thousand near copies make a thousand comparisons, not
   their square.  An n-gram with more than ``POSTING`` classes is cut into blocks; blocks meet in pairs, so no task holds them all.
4. For the pairs left, all fragments of the whole sets are counted, summed and held against the limit.

No pair that reaches the limit between two components is missed, whatever the sizes.  N-grams are told by 63-bit hashes.

Null and empty texts have no n-grams and are linked with nothing.  Rows that repeat an id are documents of their own, of one id.  Rows without an id
are linked with nothing; their component is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.llm.common import SPACE_TABLE, give_back, mix, split_by_keys, text_bytes, word_bounds, word_hashes
from solvens.llm.components import components
from solvens.session import materialise

#: Occurrences in blocks from which an n-gram is frequent, how many are at most, and n-grams of a block.
HOT, HOT_GRAMS, BLOCK = 32, 1 << 16, 1 << 20
#: Fragments that whole sets are cut into; classes of an n-gram that meet at once.
FRAGMENTS, POSTING = 4, 1024
#: r - 1 in step 2, in percent of the set and at least.
SPARE, LEAST_SPARE = 4, 3
#: Bytes of texts whose n-grams are held at once.
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240302)
PLACES = _random.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Limit:
    """Shingles of ``words`` words; linked from ``percent`` of the union on."""

    words: int = 4
    percent: int = 85

    def least_overlap(self, both: int) -> int:
        """Of two sets with ``both`` members in all."""
        return -(-self.percent * both // (100 + self.percent))

    def fragment(self, n: int) -> tuple[int, int, int]:
        """r, and the length of the first fragment as the smaller and as the larger set of a pair."""
        least = self.least_overlap(2 * n)
        spare = min(least, 1 + max(LEAST_SPARE, n * SPARE // 100))
        return spare, min(n, n - least + spare), min(n, n + self.percent * -n // 100 + spare)


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """The sorted distinct n-gram hashes of each text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES))))
        own = data[offsets[at] : offsets[to]]
        starts, ends, first = word_bounds(own, offsets[at : to + 1] - offsets[at], SPACE_TABLE)
        hashes = word_hashes(own, starts, ends)
        rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for j in range(words):
            rolled += hashes[j : j + len(rolled)] * PLACES[j]
        rolled = mix(rolled) >> np.uint64(1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                short = (hashes[a:b] * PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64)) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)
        at = to


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


MARKS = "doc_id long, n_shingles long, digest binary, grams binary, counts binary"


def _mark(limit: Limit):
    """A row per document; rows of a block's repeated n-grams have them and no ``n_shingles``."""

    def run(batches):
        held, seen, total = [], set(), 0

        def give():
            grams, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            twice = counts > 1
            row = ([None], [None], [None], [grams[twice].tobytes()], [counts[twice].astype(np.int32).tobytes()])
            held.clear(), seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=names)

        names = [x.split()[0] for x in MARKS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, digests = [], []
            for own in gram_sets(*text_bytes(batch.column("text")), limit.words):
                counts.append(len(own))
                digests.append(_digest(own))
                if digests[-1] not in seen:
                    seen.add(digests[-1])
                    held.append(own)
                    total += len(own)
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), none, none], names=names)
            if total >= BLOCK:
                yield give()
                total = 0
        if held:
            yield give()
        give_back()

    return run


def _repeated(batches):
    for batch in batches:
        for grams, counts in zip(batch.column("grams").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(grams, np.uint64).view(np.int64), np.frombuffer(counts, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1].astype(np.int64))], names=["gram", "n"])


def frequent_grams(marks: DataFrame) -> np.ndarray:
    """The n-grams at the end of the order, sorted: no more than ``HOT_GRAMS``, however large the corpus."""
    counted = marks.where("grams is not null").select("grams", "counts").mapInArrow(_repeated, "gram long, n long")
    most = counted.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "gram").limit(HOT_GRAMS)
    return np.sort(most.select("gram").toArrow().column("gram").to_numpy().view(np.uint64))


FIRST = "digest binary, n int, spare int, small int, cold int, grams binary"


def _first_fragment(limit: Limit, hot: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = []
            for own in gram_sets(*text_bytes(batch.column("text")), limit.words):
                if not len(own):
                    continue
                last = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)
                spare, small, large = limit.fragment(len(own))
                ordered = np.concatenate([own[~last], own[last]])[:large]
                rows.append((_digest(own), len(own), spare, small, int((~last).sum()), ordered.tobytes()))
            if rows:
                kinds = (pa.binary(), *(pa.int32(),) * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FIRST.split(", ")])
        give_back()

    return run


POSTINGS = "gram long, node long, tag int"
#: Bits of a posting's tag: a frequent n-gram; the set looks for partners here; above, the share of infrequent n-grams in it (per thousand).
FREQUENT, ASKS, SHARE = 1, 2, 2


def _postings(batches):
    """A row per n-gram of a first fragment."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            own = batch.slice(a, 256)
            grams = [np.frombuffer(x, np.int64) for x in own.column("grams").to_pylist()]
            sizes = np.array([len(x) for x in grams], np.int64)
            n, small, cold, dense = (own.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "small", "cold", "dense"))
            place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            asks = place < np.repeat(np.where(dense, small, np.minimum(small, cold)), sizes)
            tag = np.repeat(1000 * cold // n << SHARE, sizes) + asks * ASKS + (place >= np.repeat(cold, sizes)) * FREQUENT
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams)), pa.array(np.repeat(own.column("node").to_numpy(), sizes)), pa.array(tag.astype(np.int32))], names=["gram", "node", "tag"]
            )


def _holds_without_rare(limit: Limit, n, m, cold):
    """Whether a set of m, ``cold`` of them infrequent, may link with one of n though they have no infrequent n-gram in common."""
    return (100 + limit.percent) * (m - cold) >= limit.percent * (n + m)


def _partners(limit: Limit):
    """Condition on x and y of a posting: x is the smaller set, y lies in another component, and this n-gram may bring them together."""

    def pair(x, y):
        smaller = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["node"] < y["node"]))
        close = x["n"] * 100 >= y["n"] * limit.percent
        return smaller & close & (x["root"] != y["root"]) & (~x["frequent"] | _holds_without_rare(limit, x["n"], y["n"], y["cold"]))

    return pair


def _between_components(rooted: DataFrame, limit: Limit) -> DataFrame:
    """a, b of the pairs of components with enough common n-grams in the first fragment.  ``rooted``: postings with what is known of their sets."""
    gram = F.col("gram") == F.col("_g")

    def open_(rows):
        """Postings of those n-grams that two components share and one asks for."""
        of = rows.groupBy(F.col("gram").alias("_g")).agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max("asks").alias("any"), F.count(F.lit(1)).alias("c"))
        return rows.join(of.where("least < most and any").select("_g", "c"), gram).drop("_g")

    # A set that asks for fewer open n-grams than it needs in common has no partner as the smaller one.
    rows = open_(rooted)
    asking = rows.where("asks").groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.max("need").alias("need")).where("m >= need").select(F.col("node").alias("_n"))
    rows = rows.join(asking, F.col("node") == F.col("_n"), "left").withColumn("asks", F.col("asks") & F.col("_n").isNotNull()).drop("_n", "c")
    rows = materialise(open_(rows), "open")

    member = F.struct("node", "n", "need", "cold", "asks", "dense", "frequent", "root")
    small = rows.where(F.col("c") <= POSTING).groupBy("gram").agg(F.collect_list(member).alias("ys"))
    small = small.select(F.filter("ys", lambda x: x["asks"]).alias("xs"), F.explode("ys").alias("y"))
    # Of a long posting, blocks of those that ask meet each of the others.
    blocks = F.ceil(F.col("c") / POSTING).cast("int")
    large = rows.where(F.col("c") > POSTING).withColumn("k", blocks)
    xs = large.where("asks").groupBy(F.col("gram").alias("_g"), F.pmod(F.xxhash64("node"), "k").cast("int").alias("_i")).agg(F.collect_list(member).alias("xs"))
    ys = large.select("gram", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"), member.alias("y"))
    met = small.unionByName(ys.join(xs, gram & (F.col("i") == F.col("_i"))).select("xs", "y"))
    pairs = met.select(F.explode(F.filter("xs", lambda x: _partners(limit)(x, F.col("y")))).alias("x"), "y")
    rare = F.sum(F.when(F.col("x.frequent"), 0).otherwise(1)).alias("rare")
    of_pair = [F.max(f"{s}.{c}").alias(f"{s}_{c}") for s, c in (("x", "need"), ("x", "dense"), ("x", "n"), ("y", "n"), ("y", "cold"))]
    counted = pairs.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count(F.lit(1)).alias("common"), rare, *of_pair)
    # All infrequent n-grams of a dense x have been counted, so those of y that were not found are not in x.
    within = F.col("y_n") - F.col("y_cold") + F.col("rare")
    reached = 100 * within >= limit.percent * (F.col("x_n") + F.col("y_n") - within)
    by_rare = F.col("x_dense") & ~_holds_without_rare(limit, F.col("x_n"), F.col("y_n"), F.col("y_cold"))
    return counted.where(by_rare | (F.col("common") >= F.col("x_need"))).where(~F.col("x_dense") | reached).select("a", "b")


def _segments(limit: Limit):
    """Whole sets, cut into fragments by hash."""
    edges = np.array([min(2**63, k * -(-(2**63) // FRAGMENTS)) for k in range(FRAGMENTS + 1)], np.uint64)

    def run(batches):
        for batch in batches:
            digests, segments = [], []
            for own in gram_sets(*text_bytes(batch.column("text")), limit.words):
                if len(own):
                    at = np.searchsorted(own, edges).tolist()
                    digests.append(_digest(own))
                    segments.append([own[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(segments, pa.list_(pa.binary()))], names=["digest", "segments"])
        give_back()

    return run


def _overlap(batches):
    for batch in batches:
        common = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            common.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64())], names=["a", "b", "common"])


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, limit: Limit) -> DataFrame:
    """u, v of those pairs of classes a, b that reach the limit: partial overlaps of all fragments, summed."""
    involved = pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    of = materialise(classes.join(involved, F.col("node") == F.col("_n"), "left_semi"), "involved")
    near, _ = split_by_keys(docs, F.col("doc_id"), of.select("rep"))
    cut = near.select("text").mapInArrow(_segments(limit), "digest binary, segments array<binary>")
    own = of.select(F.col("digest").alias("_d"), "node", "n")
    cut = cut.groupBy("digest").agg(F.first("segments").alias("segments")).join(own, F.col("digest") == F.col("_d"))
    cut = materialise(cut.select("node", F.posexplode("segments").alias("fragment", "grams")), "segments")
    both = pairs.join(cut.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("x")), "a")
    both = both.join(cut.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("y")), ["b", "fragment"])
    summed = both.select("a", "b", "x", "y").mapInArrow(_overlap, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
    for side in "ab":
        summed = summed.join(own.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side)
    reached = 100 * F.col("common") >= limit.percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    return summed.where(reached).select(F.col("a").alias("u"), F.col("b").alias("v"))


def class_links(docs: DataFrame, marks: DataFrame, limit: Limit, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes (digest, node, rep, n), (u, v) of the components found by heads, and (u, v) of the links between those.

    ``known`` (doc_id, root) names components found elsewhere: pairs inside one are not looked at, and they become part of the result.
    """
    of = marks.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    classes = materialise(of.withColumn("node", F.monotonically_increasing_id()), "classes")
    first = docs.where("doc_id is not null").select("text").mapInArrow(_first_fragment(limit, frequent_grams(marks)), FIRST)
    first = first.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "spare", "small", "cold", "grams")))
    frequent = F.greatest(F.lit(0), F.col("small") - F.col("cold"))
    # Common n-grams that may be frequent ones are not waited for; a dense set has too few others, there they count as well.
    dense = frequent >= F.col("spare")
    need = F.when(dense, F.col("spare")).otherwise(F.col("spare") - frequent)
    first = first.join(classes.select(F.col("digest").alias("_d"), "node"), F.col("digest") == F.col("_d"))
    first = first.withColumns({"size": (F.octet_length("grams") / 8).cast("int"), "need": need.cast("int"), "dense": dense})
    first = materialise(first.select("node", "n", "small", "need", "dense", "size", F.least("cold", "size").alias("cold"), "grams"), "first")
    rows = first.select("node", "n", "small", "cold", "dense", "grams").mapInArrow(_postings, POSTINGS)
    head = F.min(F.struct(F.shiftright("tag", SHARE).alias("share"), "node"))["node"]
    sizes = rows.groupBy(F.col("gram").alias("_g")).agg(F.count(F.lit(1)).alias("c"), head.alias("head")).where("c > 1")
    shared = materialise(rows.join(sizes, F.col("gram") == F.col("_g")).select("gram", "node", "tag", "head"), "shared")

    met = shared.where("node <> head").groupBy("node", "head").agg(F.count(F.lit(1)).alias("m"))
    star = met.groupBy(F.col("node").alias("b")).agg(F.max_by("head", F.struct("m", -F.col("head"))).alias("a"), F.max("m").alias("m"))
    star = star.join(first.select(F.col("node").alias("b"), "size"), "b").where("2 * m >= size").select("a", "b")
    if known is not None:
        of = classes.join(known.select(F.col("doc_id").alias("rep"), F.col("root").alias("_r")), "rep").select("node", "_r")
        least = of.groupBy("_r").agg(F.min("node").alias("v"))
        given = materialise(of.join(least, "_r").where("node <> v").select(F.col("node").alias("u"), "v"), "given")
        for side in "ab":
            star = star.join(given.select(F.col("u").alias(side), F.col("v").alias(f"_{side}")), side, "left")
        star = star.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    star = materialise(star, "pairs")
    links = _linked(star, docs, classes, limit)
    links = materialise(links if known is None else links.unionByName(given), "links")
    found = components(links)

    of = first.select(F.col("node").alias("_n"), "n", "need", "dense", "cold").join(found, F.col("_n") == F.col("u"), "left").withColumn("root", F.coalesce("v", "_n")).drop("u", "v")
    flags = {"asks": F.col("tag").bitwiseAND(ASKS) > 0, "frequent": F.col("tag").bitwiseAND(FREQUENT) > 0}
    rooted = shared.join(of, F.col("node") == F.col("_n")).withColumns(flags).drop("_n", "tag", "head")
    rest = materialise(_between_components(rooted, limit).join(star, ["a", "b"], "left_anti"), "pairs")
    return classes, found, materialise(_linked(rest, docs, classes, limit), "links")


def class_components(docs: DataFrame, marks: DataFrame, limit: Limit) -> tuple[DataFrame, DataFrame]:
    """The classes (digest, node, rep, n) and (u, v): each node that isn't the smallest of its component, with that one."""
    classes, found, more = class_links(docs, marks, limit)
    if more.limit(1).count():
        found = components(found.unionByName(more))
    return classes, found


def joining_links(docs: DataFrame, limit: Limit, known: DataFrame) -> DataFrame:
    """u, v: pairs of ids that join the components ``known`` (doc_id, root) of ``docs`` (doc_id, text) wherever texts link across them."""
    marked = materialise(docs.mapInArrow(_mark(limit), MARKS), "marks")
    classes, found, more = class_links(docs, marked, limit, known)
    rep = classes.select("node", "rep")
    pairs = found.unionByName(more).join(rep.withColumnsRenamed({"node": "u", "rep": "_u"}), "u").join(rep.withColumnsRenamed({"node": "v", "rep": "_v"}), "v")
    return pairs.select(F.col("_u").alias("u"), F.col("_v").alias("v"))


def similar_groups(docs: DataFrame, limit: Limit = Limit(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialise(docs.mapInArrow(_mark(limit), MARKS), "marks")
    marks = marked.where("n_shingles is not null").select("doc_id", "n_shingles", "digest")
    classes, found = class_components(docs, marked, limit)
    roots = classes.join(found, F.col("node") == F.col("u"), "left").select("digest", "rep", F.coalesce("v", "node").alias("root"))
    least = roots.groupBy(F.col("root").alias("_r")).agg(F.min("rep").alias("component"))
    of = roots.join(least, F.col("root") == F.col("_r")).select(F.col("digest").alias("_d"), "component")
    out = marks.join(of, F.col("digest") == F.col("_d"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
