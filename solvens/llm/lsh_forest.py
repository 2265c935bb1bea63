"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct shingles of five words.  Documents of equal sets form a
class, told by a digest of the whole set; one of each class goes on.  A signature has ``HASHES`` minima.  Each
of ``TREES`` trees orders the documents by a sequence of its own of these minima; documents that agree in the first values
of the sequence are neighbours there, and the longer the common prefix, the more alike they are.

Every region (documents of equal prefix) starts at depth ``DEPTHS[0]``.  A region of at most ``REGION`` documents gives
its pairs as candidates; a larger one is cut up by the next depth, on its own, until its parts are small.  Members
of large regions are paired with the region's smallest document besides, at every depth, so that large groups of near copies
hang together.  Depth adapts to each region; no member is dropped.

Where many documents are alike but for some (one template, a long quotation), two that link may part in every tree before their region
is small.  Documents that stand in large regions of more than ``CROWDED`` trees are therefore joined exactly, by their shared
shingles (``ngram_join``), between the components that the trees have found; so region sizes lose no link.

Candidates whose signatures agree in less than ``LEAST_ALIKE`` of all minima are let go (a pair at the limit of .75
has a share below that with odds of about 1 in 30,000).  The others are confirmed on the full sets: first each
document with its most alike partner, then, between the components found so far, every other candidate.  Pairs
inside a component need no confirmation, which keeps the work in line with the documents.

A pair at the limit agrees to depth 4 in a tree with probability .32 and is missed by 40 trees with about
1 in 10,000, more alike pairs far more seldom; every link that is reported is exact.

Null and empty texts have no shingles and are linked with nothing.  Rows that repeat an id with equal text
share their result.  Rows without an id are never linked and not marked as kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.llm.common import SPACE_TABLE, fresh_name, give_back, mix, split_by_keys, text_bytes, word_bounds, word_hashes
from solvens.llm.components import components
from solvens.llm.ngram_join import Limit, joining_links
from solvens.session import materialise

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
HASHES, TREES, DEPTHS, REGION = 96, 40, (4, 8, 12, 16), 8
LEAST_ALIKE = 0.55
#: Trees in which a document may stand in a large region: in the others a pair at the limit is missed with odds of .68 ** (TREES - CROWDED).
CROWDED = 4
#: Bytes of texts whose shingles are held at once.
SLICE_BYTES = 1 << 20

_random = np.random.default_rng(20240301)
PLACES = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _random.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _random.integers(0, 2**64, HASHES, dtype=np.uint64)
#: Which minima each tree compares, in its order.
ORDERS = np.array([_random.permutation(HASHES)[: DEPTHS[-1]] for _ in range(TREES)])
PREFIX = _random.integers(1, 2**63, (TREES, DEPTHS[-1]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """The sorted distinct shingle hashes of each text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES))))
        own = data[offsets[at] : offsets[to]]
        starts, ends, first = word_bounds(own, offsets[at : to + 1] - offsets[at], SPACE_TABLE)
        words = word_hashes(own, starts, ends)
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for j in range(SHINGLE):
            rolled += words[j : j + len(rolled)] * PLACES[j]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(rolled[a : b - SHINGLE + 1])
            elif b > a:
                short = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = to


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set that isn't empty."""
    out = np.empty(HASHES, np.uint32)
    for a in range(0, HASHES, 16):
        low = np.full(16, 2**32 - 1, np.uint64)
        for k in range(0, len(shingles), 4096):
            hashed = ((shingles[k : k + 4096, None] ^ SHIFTS[None, a : a + 16]) * FACTORS[None, a : a + 16]) >> np.uint64(32)
            low = np.minimum(low, hashed.min(axis=0))
        out[a : a + 16] = low
    return out


MARKS = "doc_id long, n_shingles long, digest binary, minima binary, brief binary"


def _mark(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        counts, digests, minima, brief = [], [], [], []
        for own in shingle_sets(*text_bytes(batch.column("text"))):
            counts.append(len(own))
            if len(own):
                values = signature(own)
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                minima.append(values.tobytes())
                brief.append(values.astype(np.uint8).tobytes())
            else:
                digests.append(None), minima.append(None), brief.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, minima, brief))],
            names=["doc_id", "n_shingles", "digest", "minima", "brief"],
        )
    give_back()


def _prefix_keys(minima: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    """64-bit keys of the first ``depth`` values of each given tree, for rows of minima: (rows, trees)."""
    values = minima[:, ORDERS[trees][:, :depth]].astype(np.uint64) + np.uint64(1)
    return mix((values * PREFIX[trees][None, :, :depth]).sum(axis=2, dtype=np.uint64) + trees.astype(np.uint64)[None, :]).view(np.int64)


def _first_keys(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, HASHES)
        trees = np.arange(TREES)
        keys = _prefix_keys(minima, trees, DEPTHS[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), TREES)), pa.array(np.tile(trees.astype(np.int8), len(keys)))],
            names=["key", "rep", "tree"],
        )


def _deeper_keys(batches):
    """rep, its trees with a large region, its minima -> keys of all deeper levels."""
    for batch in batches:
        out = [[] for _ in range(1 + len(DEPTHS[1:]))]
        for rep, trees, raw in zip(batch.column("rep").to_pylist(), batch.column("trees").to_pylist(), batch.column("minima").to_pylist(), strict=True):
            minima = np.frombuffer(raw, np.uint32)[None, :]
            trees = np.array(trees)
            out[0].append(np.full(len(trees), rep))
            for level, depth in enumerate(DEPTHS[1:], 1):
                out[level].append(_prefix_keys(minima, trees, depth)[0])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["rep", *(f"key{d}" for d in DEPTHS[1:])])


def _region_pairs(rows: DataFrame, key: str) -> DataFrame:
    """a, b of all pairs in the small regions of ``rows``."""
    members = rows.groupBy(key).agg(F.sort_array(F.collect_set("rep")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(REGION)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def candidate_pairs(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a < b: neighbours in the trees, by regions of adaptive depth; rep of those in many large regions.  ``reps`` has rep and minima."""
    rows = reps.select("rep", "minima").mapInArrow(_first_keys, "key long, rep long, tree byte")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).where("n > 1")
    shared = materialise(rows.join(sizes, "key"), "regions")
    pairs = _region_pairs(shared.where(F.col("n") <= REGION), "key")
    large = shared.where(F.col("n") > REGION)
    stars = large.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    wide = materialise(large.groupBy("rep").agg(F.collect_set(F.col("tree").cast("int")).alias("trees")), "wide")
    deeper = wide.join(reps.select("rep", "minima"), "rep").mapInArrow(_deeper_keys, "rep long, " + ", ".join(f"key{d} long" for d in DEPTHS[1:]))
    rest = materialise(deeper, "deeper")
    for depth in DEPTHS[1:]:
        key = f"key{depth}"
        sizes = rest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).where("n > 1")
        sized = materialise(rest.join(sizes, key), "deeper")
        pairs = pairs.unionByName(_region_pairs(sized.where(F.col("n") <= REGION), key))
        large = sized.where(F.col("n") > REGION)
        stars = stars.unionByName(large.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct())
        rest = large.drop("n", "head")
    return pairs.unionByName(stars).where("a < b").distinct(), wide.where(F.size("trees") > CROWDED).select("rep")


def _alike(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("x", "y"))
        share = (x == y).mean(axis=1)
        keep = pa.array(share >= LEAST_ALIKE)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share.astype(np.float32))], names=["a", "b", "alike"]).filter(keep)


def _confirm(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        keep = []
        left, right = (list(shingle_sets(*text_bytes(batch.column(c)))) for c in ("x", "y"))
        for s, t in zip(left, right, strict=True):
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(DENOMINATOR * common >= NUMERATOR * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, of: DataFrame, value: str) -> DataFrame:
    """``pairs`` with x and y, the values of a and b."""
    return pairs.join(of.select(F.col("rep").alias("a"), F.col(value).alias("x")), "a").join(of.select(F.col("rep").alias("b"), F.col(value).alias("y")), "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialise(docs.mapInArrow(_mark, MARKS), "marks")
    classes = marks.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = marks.where("digest is not null").join(classes.select("rep", F.col("digest").alias("_d")), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("_d")))
    # An id with several texts may stand for several classes: it keeps them apart by joining them.
    reps = materialise(reps.dropDuplicates(["rep"]).select("rep", "minima", "brief"), "reps")
    candidates, crowd = candidate_pairs(reps)
    pairs = materialise(_with_both(candidates, reps, "brief").mapInArrow(_alike, "a long, b long, alike float"), "pairs")

    involved = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).unionByName(crowd).distinct()
    involved = materialise(involved, "involved")
    near, _ = split_by_keys(docs, F.col("doc_id"), involved)
    texts = near.join(involved, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])
    texts = materialise(texts.withColumnRenamed("doc_id", "rep"), "texts")

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b"))
    first = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(_with_both(first, texts, "text").mapInArrow(_confirm, "u long, v long"), "links")
    found = components(links)

    def root(name):
        return found.select(F.col("u").alias(name), F.col("v").alias(f"{name}_root"))

    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    apart = apart.select("a", "b").join(first, ["a", "b"], "left_anti")
    more = materialise(_with_both(apart, texts, "text").mapInArrow(_confirm, "u long, v long"), "links")
    if more.limit(1).count():
        found = components(found.unionByName(more))
    if crowd.limit(1).count():
        known = crowd.join(root("rep"), "rep", "left").select(F.col("rep").alias("doc_id"), F.coalesce("rep_root", "rep").alias("root"))
        dense = materialise(texts.join(crowd, "rep", "left_semi").withColumnRenamed("rep", "doc_id"), "dense")
        across = materialise(joining_links(dense, Limit(SHINGLE, NUMERATOR), materialise(known, "known")), "links")
        found = components(found.unionByName(across))
    member = marks.select("doc_id", "n_shingles", "digest")
    out = member.join(classes.select(F.col("digest").alias("_d"), "rep"), F.col("digest") == F.col("_d"), "left")
    out = out.join(found.select(F.col("u").alias("_u"), F.col("v").alias("root")), F.col("rep") == F.col("_u"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for those whose document has a smaller id in its component; rows without an id stay."""
    own = fresh_name(docs, "_dropped")
    judged = near_groups(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    dropped = materialise(judged.where("not kept").select(F.col("doc_id").alias(own)), "dropped")
    near, rest = split_by_keys(docs, F.col(id_col).cast("long"), dropped)
    return rest.unionByName(near.join(dropped, F.col(id_col).cast("long") == F.col(own), "left_anti"))
