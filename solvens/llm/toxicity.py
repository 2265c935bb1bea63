"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbouring words and pairs with one word
between them, hashed into ``BUCKETS``.  Words are runs of letters, digits and bytes above ASCII, A-Z
counted as a-z.  Each coordinate has its own learning rate, and the L1 term keeps most weights at zero:
what is sent to the tasks that score is the list of weights that are not, at most ``BUCKETS``.

Labels come from at most ``MAX_ROWS`` rows outside the part held out; one task learns from them, row after row,
and the bound doesn't grow with the input.  Whole texts are read, in learning and in scoring.

Null and empty texts have no features: their score is that of the bias.  Without any labelled row every
score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from solvens.llm.common import LOOSE_TABLE, add_columns, fresh_name, give_back, mix, text_bytes, word_bounds, word_hashes
from solvens.llm.labelled import held_out, labelled_sample

BUCKETS = 1 << 20
MAX_ROWS = 20_000
EPOCHS = 8
#: Rate and its offset, L1 and L2 of the per-coordinate updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 20.0, 0.0
#: L1 is this times the root of the number of rows where that is less: chance sums of gradients grow with the root.
L1_ROOT = 1 / 3
MODULUS, LEFT_OUT, THRESHOLD = 5, 0, 0.5
#: Bytes of texts whose features are held at once.
SLICE_BYTES = 1 << 20

PAIR, SKIP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A3564E27F8862B)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every word, pair and skip pair; repeats included."""
    starts, ends, first = word_bounds(data, offsets, LOOSE_TABLE)
    h = word_hashes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    parts, owners = [h], [text]
    for gap, factor in ((1, PAIR), (2, SKIP)):
        if len(h) > gap:
            same = text[:-gap] == text[gap:]
            parts.append(mix(h[:-gap] * factor + h[gap:])[same])
            owners.append(text[gap:][same])
    return np.concatenate(owners), (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int64)


def slices(offsets: np.ndarray):
    """Ranges of texts of about ``SLICE_BYTES`` together."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES))))
        yield at, to
        at = to


def ftrl(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over ``rows`` (distinct buckets of each text) in their order."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias = bias_n = 0.0
    l1 = min(L1, L1_ROOT * np.sqrt(len(rows)))

    def weights(z_, n_):
        return -np.sign(z_) * np.maximum(np.abs(z_) - l1, 0) / ((BETA + np.sqrt(n_)) / ALPHA + L2)

    for _ in range(epochs):
        for own, label in zip(rows, y, strict=True):
            zo, no = z[own], n[own]
            w = weights(zo, no)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            root = np.sqrt(no + g * g)
            z[own] = zo + g - (root - np.sqrt(no)) / ALPHA * w
            n[own] = no + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    return weights(z, n), bias


def _learn(key, table):
    table = table.sort_by([("_order", "ascending")])
    y = table.column("y").to_numpy()
    rows: list[np.ndarray] = []
    data, offsets = text_bytes(table.column("text"))
    for a, b in slices(offsets):
        text, bucket = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        pairs = np.unique(text * BUCKETS + bucket)
        rows += np.split((pairs % BUCKETS).astype(np.int32), np.searchsorted(pairs, np.arange(1, b - a) * BUCKETS))
    w, bias = ftrl(rows, y)
    del rows, data
    give_back()
    some = np.flatnonzero(w)
    index = np.r_[some, BUCKETS]
    return pa.table({"bucket": pa.array(index, pa.int64()), "weight": pa.array(np.r_[w[some], bias], pa.float64())})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias."""
    sample = labelled_sample(docs, labels, "toxic", MODULUS, LEFT_OUT, max_rows)
    learnt = sample.groupBy(F.lit(0).alias("one")).applyInArrow(_learn, "bucket long, weight double").toArrow().sort_by("bucket")
    bucket, weight = (learnt.column(c).to_numpy() for c in ("bucket", "weight"))
    if not len(bucket):
        return bucket, weight, -np.inf
    return bucket[:-1], weight[:-1], float(weight[-1])  # the bias stands last


def score_texts(column, bucket: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Probability of each text of an Arrow column."""
    dense = np.zeros(BUCKETS)
    dense[bucket] = weight
    data, offsets = text_bytes(column)
    margin = np.full(len(offsets) - 1, bias)
    for a, b in slices(offsets):
        text, own = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hit = dense[own] != 0
        pairs = np.unique(text[hit] * BUCKETS + own[hit])
        margin[a:b] += np.bincount(pairs // BUCKETS, dense[pairs % BUCKETS], b - a)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-margin))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score, predicted and held_out."""
    bucket, weight, bias = fit(docs, labels)

    def run(texts):
        p = score_texts(texts, bucket, weight, bias)
        return pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())

    scored = add_columns(docs, ["text"], [StructField("score", DoubleType()), StructField("predicted", IntegerType())], run)
    return scored.withColumn("held_out", held_out("doc_id", MODULUS, LEFT_OUT))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with the columns of ``docs``."""
    bucket, weight, bias = fit(docs, labels)
    mark = fresh_name(docs, "_toxic")

    def run(texts):
        return (pa.array((score_texts(texts, bucket, weight, bias) >= THRESHOLD).astype(np.int32), pa.int32()),)

    return add_columns(docs, ["text"], [StructField(mark, IntegerType())], run).where(F.col(mark) == 0).drop(mark)
