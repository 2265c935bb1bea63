"""How the filters of a corpus interact, in every order they could be applied in.

Each document has a failure mask: one bit per filter that it fails.  Masks are counted per part by grouped sums, so a part of any
size becomes at most ``2 ** len(FILTERS)`` weighted masks.  These are held as a count-weighted decision diagram: a node tests one
filter and has a child for documents that pass it and one for those that fail; its weight is the sum of its children's, a leaf's is
the weight of its mask (documents, good ones, toxic ones), and equal subgraphs are one node.  In the order of the diagram the all-pass path,
from the root through the pass children, shows each step: what the fail child weighs is removed, what the pass child weighs is kept.
All orders are visited by swapping adjacent levels, one swap from each order to the next; nothing is counted again.

Filters, on whole texts (null counts as empty; words are runs without white space, case matters):
A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of the code points; D any of ``#$%&*|``;
E equal to the text of a row with a smaller id, anywhere in the table.

Rows without an id have no label, never fail E and make no other row fail it.  Rows that repeat an id don't fail E by each other.  Of repeated
labels the largest counts.  A null part is the empty string.  An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WORDS_LEAST, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 50, 65, 5, "#$%&*|"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


class Diagram:
    """A decision diagram over weighted masks, reduced by sharing equal nodes; a node is (level, pass child, fail child)."""

    def __init__(self, weights: dict[int, tuple[int, ...]], variables: int):
        self.order = list(range(variables))
        self.unique: dict[tuple, int] = {}
        self.nodes: list[tuple] = []
        self.weight: list[tuple[int, ...]] = []
        width = len(next(iter(weights.values()), (0,)))
        self.root = self._build(weights, 0, 0, (0,) * width)

    def _node(self, level: int, passed, failed) -> int:
        """The node of these children, or the leaf of this weight (level ``len(order)``)."""
        key = (level, passed, failed)
        if key not in self.unique:
            self.unique[key] = len(self.nodes)
            self.nodes.append(key)
            self.weight.append(passed if failed is None else tuple(x + y for x, y in zip(self.weight[passed], self.weight[failed], strict=True)))
        return self.unique[key]

    def _build(self, weights, level: int, mask: int, none) -> int:
        if level == len(self.order):
            return self._node(level, weights.get(mask, none), None)
        return self._node(level, self._build(weights, level + 1, mask, none), self._build(weights, level + 1, mask | 1 << level, none))

    def swap(self, level: int) -> None:
        """Exchanges the variables of ``level`` and the next: grandchildren change places, lower levels stay as they are."""
        done: dict[int, int] = {}

        def rebuilt(node: int) -> int:
            if node not in done:
                at, passed, failed = self.nodes[node]
                if at < level:
                    done[node] = self._node(at, rebuilt(passed), rebuilt(failed))
                else:
                    (_, both, second), (_, first, neither) = self.nodes[passed], self.nodes[failed]
                    done[node] = self._node(at, self._node(at + 1, both, first), self._node(at + 1, second, neither))
            return done[node]

        self.root = rebuilt(self.root)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass_path(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Of each level: what is kept and what is removed."""
        out, node = [], self.root
        for _ in self.order:
            _, passed, failed = self.nodes[node]
            out.append((self.weight[passed], self.weight[failed]))
            node = passed
        return out


def adjacent_swaps(n: int) -> list[int]:
    """The levels to swap so that all orders of ``n`` variables come by, each once: the last variable wanders through every order of the others."""
    if n < 2:
        return []
    inner, out, down = adjacent_swaps(n - 1), [], True
    for k in range(len(inner) + 1):
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if k < len(inner):
            out.append(inner[k] + down)  # the others stand one level lower while the wanderer is on top
        down = not down
    return out


def audit_masks(weights: dict[int, tuple[int, int, int]], names: str = FILTERS) -> list[tuple]:
    """filter_order, step and the counts, of all orders of the filters, for one part's masks with (documents, good, toxic)."""
    n = len(names)
    diagram = Diagram(weights, n)
    paths = {}
    for level in [None, *adjacent_swaps(n)]:
        if level is not None:
            diagram.swap(level)
        paths[tuple(diagram.order)] = diagram.all_pass_path()
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for order, path in paths.items():
        fails[order[0]] = path[0][1][0]  # as first filter it removes all that fail it
        alone[order[-1]] = path[-1][1][0]  # as last one those that fail nothing else
        for variable, (_, removed) in zip(order, path, strict=True):
            shapley[variable] += removed[0]
    out = []
    for order, path in paths.items():
        label = "".join(names[v] for v in order)
        for step, (v, (kept, removed)) in enumerate(zip(order, path, strict=True), 1):
            out.append((label, step, kept[0], removed[0], fails[v] - removed[0], alone[v], removed[1], removed[2], shapley[v]))
    return out


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: which of A to D a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    tests = (n < WORDS_LEAST, 100 * kinds < DISTINCT_PERCENT * n, 100 * capitals > CAPITALS_PERCENT * F.length(text), text.rlike("[" + MARKS + "]"))
    return sum((F.when(t, F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(tests)), F.lit(0)).cast("byte")


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part by what they fail.

    Rows are counted by everything that matters of them before any key meets itself: a text or part
    that holds a third of all rows moves as a few counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text_mask(text).alias("own"),
    )
    known = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1))).groupBy(F.col("doc_id").alias("_l"))
    known = known.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    kinds = ("part", "digest", "own", "good", "toxic")
    with_id = rows.where("_id is not null").join(known, F.col("_id") == F.col("_l"), "left")
    flagged = with_id.select("_id", "part", "digest", "own", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    flagged = flagged.unionByName(rows.where("_id is null").withColumns({"good": no, "toxic": no}))
    by_id = flagged.groupBy("_id", *kinds).agg(F.count(F.lit(1)).alias("c"))
    # Of the rows of one kind, those with the least id are the only ones that may be the first of their text.
    grouped = by_id.groupBy(*kinds).agg(
        F.sum("c").alias("n"), F.min("_id").alias("least"), F.sum(F.when(F.col("_id").isNull(), F.col("c")).otherwise(0)).alias("without"),
        F.coalesce(F.max_by("c", -F.col("_id")), F.lit(0)).alias("at_least"),
    )
    first = grouped.groupBy(F.col("digest").alias("_d")).agg(F.min("least").alias("first"))
    judged = grouped.join(first, F.col("digest") == F.col("_d"))
    passes = F.col("without") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.col("own").cast("int").alias("mask"), passes.alias("n")), F.struct((F.col("own") + 16).cast("int").alias("mask"), (F.col("n") - passes).alias("n")))
    weighted = judged.select("part", "good", "toxic", F.explode(both).alias("w")).select("part", "good", "toxic", "w.mask", "w.n").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return weighted.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def _audit(batches):
    names = [x.split()[0] for x in AUDIT.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in AUDIT.split(", ")]
    for batch in batches:
        for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
            rows = audit_masks({m["mask"]: (m["n"], m["good"], m["toxic"]) for m in masks})
            columns = [[part] * len(rows), *map(list, zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The columns of ``AUDIT``: one row per part, order of the filters and step."""
    masks = failure_masks(docs, labels, id_col, text_col, part_col)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32 to a part
    return parts.mapInArrow(_audit, AUDIT)
