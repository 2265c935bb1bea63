"""Quality classifier: a byte-level convolutional network in numpy.

Filters over ``WIDTH`` bytes run along the whole text in steps of ``STRIDE``.  A filter is a table: one learnt
number per place and byte value, summed over the places.  Their outputs are max-pooled in chunks that overlap by half
and together cover the whole text; the chunks' maxima are averaged and maximised over the text, and one
logistic unit combines both into a probability.  A text that repeats itself excites few filters per chunk, which
the average shows; odd symbols excite some filters anywhere, which the maximum shows.

It is fitted with Adam on at most ``MAX_ROWS`` labelled rows outside the part held out, in one task; the bound
doesn't grow with the input.  Scoring reads whole texts, long ones in pieces.

Null and empty texts are scored as one chunk of zero bytes.  Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from solvens.llm.common import add_columns, text_bytes
from solvens.llm.labelled import held_out, labelled_sample

WIDTH, STRIDE, FILTERS = 6, 2, 16
#: Filter positions of half a chunk.
HALF = 64
#: Half chunks worked on at once.
PIECE = 512
MAX_ROWS = 6_000
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.03, 1e-4
#: Few rows are gone over more often, until so many steps are made.
LEAST_STEPS = 600
MODULUS, LEFT_OUT, THRESHOLD = 4, 2, 0.7


class Network:
    """Parameters: ``filters`` (place, byte, filter), ``bend`` (filter), ``out`` (mean part, max part), ``bias``."""

    def __init__(self, seed: int = 7):
        random = np.random.default_rng(seed)
        self.filters = random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bend = np.zeros(FILTERS, np.float32)
        self.out = random.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self):
        return [self.filters, self.bend, self.out, self.bias]

    def half_chunks(self, text: np.ndarray, places: bool = False):
        """Maximum of every filter in each half chunk, and, if asked for, the positions of the maxima."""
        step = HALF * STRIDE
        halves = max(1, -(-max(0, len(text) - WIDTH + STRIDE) // step))
        padded = np.zeros(halves * step + WIDTH, np.uint8)
        padded[: len(text)] = text
        best = np.empty((halves, FILTERS), np.float32)
        where = np.empty((halves, FILTERS), np.int64) if places else None
        for a in range(0, halves, PIECE):
            b = min(halves, a + PIECE)
            n = (b - a) * HALF
            total = np.zeros((n, FILTERS), np.float32)
            for j in range(WIDTH):
                total += self.filters[j][padded[a * step + j :: STRIDE][:n]]
            total = total.reshape(b - a, HALF, FILTERS)
            best[a:b] = total.max(axis=1)
            if places:
                where[a:b] = (np.arange(a, b)[:, None] * HALF + total.argmax(axis=1)) * STRIDE
        return best, where, padded

    def chunks(self, best: np.ndarray):
        """Maxima of chunks of two half chunks that overlap by one, and which half each maximum comes from."""
        if len(best) == 1:
            return best, np.zeros_like(best, np.int64)
        later = best[1:] > best[:-1]
        return np.where(later, best[1:], best[:-1]), np.arange(len(best) - 1)[:, None] + later

    def features(self, text: np.ndarray) -> np.ndarray:
        top, _ = self.chunks(self.half_chunks(text)[0])
        shaped = np.tanh(top + self.bend)
        return np.concatenate([shaped.mean(axis=0), shaped.max(axis=0)])

    def margin(self, text: np.ndarray) -> float:
        return float(self.features(text) @ self.out + self.bias[0])

    def gradient(self, text: np.ndarray, y: float, grads: list[np.ndarray]) -> None:
        """Adds the gradient of the log loss of one text."""
        best, where, padded = self.half_chunks(text, places=True)
        top, half = self.chunks(best)
        shaped = np.tanh(top + self.bend)
        peak = shaped.argmax(axis=0)
        columns = np.arange(FILTERS)
        pooled = np.concatenate([shaped.mean(axis=0), shaped[peak, columns]])
        miss = np.float32(1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias[0], -30, 30))) - y)
        grads[2] += miss * pooled
        grads[3] += miss
        back = np.repeat((miss * self.out[:FILTERS] / len(top))[None], len(top), axis=0)
        back[peak, columns] += miss * self.out[FILTERS:]
        back *= 1 - shaped * shaped
        grads[1] += back.sum(axis=0)
        spot = where[half, columns]
        for j in range(WIDTH):
            np.add.at(grads[0][j], (padded[spot + j], np.broadcast_to(columns, spot.shape)), back)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """A network fitted to the texts (as bytes) and labels."""
    net, random = Network(), np.random.default_rng(11)
    share = np.clip(y.mean(), 0.01, 0.99)
    net.bias[0] = np.log(share / (1 - share))
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    each = -(-len(texts) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    total = epochs * each
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in net.parameters()]
            own = order[a : a + BATCH]
            for i in own:
                net.gradient(texts[i], y[i], grads)
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, v in zip(net.parameters(), grads, first, second, strict=True):
                g /= len(own)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + DECAY * p)
    return net


def _learn(key, table):
    table = table.sort_by([("_order", "ascending")])
    data, offsets = text_bytes(table.column("text"))
    texts = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    net = train(texts, table.column("y").to_numpy().astype(np.float32))
    return pa.table({"part": pa.array(range(4), pa.int32()), "values": pa.array([p.astype(np.float32).tobytes() for p in net.parameters()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network | None:
    """The network fitted to the labelled sample; None without labels."""
    sample = labelled_sample(docs, labels, "quality", MODULUS, LEFT_OUT, max_rows)
    parts = sample.groupBy(F.lit(0).alias("one")).applyInArrow(_learn, "part int, values binary").collect()
    if not parts:
        return None
    net = Network()
    for row in parts:
        own = net.parameters()[row["part"]]
        own[...] = np.frombuffer(row["values"], np.float32).reshape(own.shape)
    return net


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score, predicted and held_out."""
    net = fit(docs, labels)

    def run(texts):
        data, offsets = text_bytes(texts)
        if net is None:
            p = np.full(len(offsets) - 1, 0.5)
        else:
            margins = np.array([net.margin(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], float)
            p = 1 / (1 + np.exp(-np.clip(margins, -500, 500)))
        return pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())

    scored = add_columns(docs, ["text"], [StructField("score", DoubleType()), StructField("predicted", IntegerType())], run)
    return scored.withColumn("held_out", held_out("doc_id", MODULUS, LEFT_OUT))
