"""Exact nearest neighbours inside a class, without comparing all pairs.

A k-d tree over a sample cuts each class into cells of bounded size.  A task holds one cell, finds the neighbours of its points there and so an upper bound
for each k-th distance; only points whose ball of that radius reaches the box around another cell visit it.  Within a cell, blocks of near points
are compared with blocks by matrix products, nearest boxes first; what such a product can't rule out, rounding included, is computed feature by feature.
Many visitors of a cell are dealt to several tasks, so neither a dense cell nor a group of copies has to fit into one.  Copies are counted, not compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvens.session import materialise

HIT_SCHEMA = "cls int, pid string, other string, dist double, mult bigint, vec array<double>"
#: Sampled points of a class per cell, from which cells are cut.
SAMPLED = 64
#: Points compared with a block of queries at once, and (query, cell) pairs tested at once.
CHUNK, TESTED = 4_096, 1 << 20
#: Rows of a batch that visits other cells.
VISITORS = 8_192


def distinct_points(df: DataFrame, cls: str, row_id: str, features: list[str] | str) -> DataFrame:
    """Equal rows of a class become one point (id of the first row, number of copies).

    ``features`` are columns, or one array column that is taken at its full length.
    """
    if isinstance(features, str):
        vec = F.col(features).cast("array<double>")
    else:
        vec = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    rows = df.select(F.col(cls).cast("int").alias("cls"), F.col(row_id).cast("string").alias("row_id"), vec.alias("vec"))
    return rows.groupBy("cls", "vec").agg(F.min("row_id").alias("pid"), F.count(F.lit(1)).alias("mult"))


# --- cells -------------------------------------------------------------------


def kd_blocks(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of ``x`` in groups of at most ``most``, halved along their widest feature."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        own, half = x[rows], len(rows) // 2
        by = np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], half)
        stack += [rows[by[half:]], rows[by[:half]]]
    return out


def kd_tree(x: np.ndarray, cells: int) -> tuple[np.ndarray, ...]:
    """(feature, limit, left, right, cell) of the nodes of a tree with at most ``cells`` leaves; values up to the limit go left."""
    nodes: list[list] = []
    stack, found = [(np.arange(len(x)), cells, -1, 0)], 0
    while stack:
        rows, wanted, parent, side = stack.pop()
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = at
        cut = _cut(x[rows], wanted) if wanted > 1 and len(rows) > 1 else None
        if cut is None:
            nodes[at][4], found = found, found + 1
            continue
        nodes[at][:2] = cut
        low = x[rows, cut[0]] <= cut[1]
        share = min(wanted - 1, max(1, round(wanted * low.mean())))
        stack += [(rows[~low], wanted - share, at, 1), (rows[low], share, at, 0)]
    return tuple(np.array([n[i] for n in nodes], float if i == 1 else np.int64) for i in range(5))


def _cut(x: np.ndarray, wanted: int) -> tuple[int, float] | None:
    """Of the widest features that can be cut near the middle, the first; else the most even cut there is."""
    spread, share, best = x.max(axis=0) - x.min(axis=0), (wanted // 2) / wanted, (2.0, None)
    for f in np.argsort(-spread, kind="stable"):
        if spread[f] <= 0:
            break
        values = np.sort(x[:, f])
        i = int(np.clip(round(share * len(values)) - 1, 0, len(values) - 2))
        for limit in {values[i], values[np.searchsorted(values, values[i]) - 1] if values[i] > values[0] else values[0]}:
            part = np.searchsorted(values, limit, side="right") / len(values)
            if part < 1 and abs(part - share) < best[0]:
                best = abs(part - share), (int(f), float(limit))
        if best[0] < 0.1:
            break
    return best[1]


def _cell_of(x: np.ndarray, tree: tuple | None) -> np.ndarray:
    if tree is None:
        return np.zeros(len(x), np.int32)
    feature, limit, left, right, cell = tree
    at = np.zeros(len(x), np.int64)
    while len(rows := np.flatnonzero(left[at] >= 0)):
        node = at[rows]
        at[rows] = np.where(x[rows, feature[node]] <= limit[node], left[node], right[node])
    return cell[at].astype(np.int32)


def _trees(points: DataFrame, sizes: dict[int, int], cell: int, most: int) -> dict[int, tuple]:
    """Trees of the classes that need more than one cell, from a sample bounded by the number of cells."""
    cells = {c: min(most, -(-n // cell)) for c, n in sizes.items() if n > cell}
    share = F.lit(0.0)
    for c, n in cells.items():
        share = F.when(F.col("cls") == c, F.lit(SAMPLED * n / sizes[c])).otherwise(share)
    drawn = F.pmod(F.xxhash64("pid", "vec"), F.lit(1 << 40)) < share * float(1 << 40)
    found: dict[int, list] = {}
    for r in points.filter(drawn).select("cls", "vec").collect() if cells else []:
        if all(v is not None and math.isfinite(v) for v in r.vec):
            found.setdefault(r.cls, []).append(r.vec)
    # Sorted, so that the order in which rows arrive changes nothing.
    return {c: kd_tree(np.array(sorted(v), float), cells[c]) for c, v in found.items()}


def _placed(points: DataFrame, trees: dict) -> DataFrame:
    """Points with their cell; those with a value that is missing or not finite have no distance to any other and are left out."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, x = batch.column("cls").to_numpy(), _matrix(batch.column("vec"))
            cell = np.zeros(len(x), np.int32)
            good = np.isfinite(x).all(axis=1)
            for c in np.unique(cls):
                rows = np.flatnonzero(good & (cls == c))
                cell[rows] = _cell_of(x[rows], trees.get(int(c)))
            yield batch.append_column("cell", pa.array(cell)).filter(pa.array(good))

    return points.select("cls", "vec", "pid", "mult", "asks").mapInArrow(run, "cls int, vec array<double>, pid string, mult bigint, asks boolean, cell int")


# --- search in one cell --------------------------------------------------------


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(column) and len(values) % len(column):
        raise ValueError("vectors differ in length")
    return values.reshape(len(column), -1)


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances row by row, summed feature by feature."""
    acc = np.zeros(len(a))
    for f in range(a.shape[1]):
        acc += np.square(a[:, f] - b[:, f])
    return np.sqrt(acc)


class Cell:
    """The points of a cell, in blocks; ``code`` tells equal ids, ``rank`` orders ids."""

    def __init__(self, x: np.ndarray, code: np.ndarray, rank: np.ndarray, block: int):
        blocks = kd_blocks(x, block)
        self.place = np.concatenate(blocks)
        self.x, self.code, self.rank, self.block = x[self.place], code[self.place], rank[self.place], block
        self.ends = np.cumsum([len(b) for b in blocks])
        self.starts = self.ends - [len(b) for b in blocks]
        self.low = np.minimum.reduceat(self.x, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.x, self.starts, axis=0)
        self.middle = (self.low.min(axis=0) + self.high.max(axis=0)) / 2
        moved = self.x - self.middle
        norm = np.square(moved).sum(axis=1)
        # Room for the rounding of a product, per unit of both norms: products give lower limits of squared distances.
        self.slack, self.farthest = 8 * (x.shape[1] + 6) * np.finfo(float).eps, norm.max()
        self.sides = np.column_stack([moved, norm * (1 - self.slack), np.ones(len(norm))])

    def nearest(self, q: np.ndarray, code: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance) of up to ``k`` points within ``bound`` of each query whose code differs, by query, distance and rank."""
        parts = [self._block(q, code, bound, k, rows) for rows in kd_blocks(q, self.block)]
        row, at, dist = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.argsort(row, kind="stable")
        return row[by], self.place[at[by]], dist[by]

    def _block(self, q, code, bound, k, rows):
        q, code = q[rows], code[rows]
        gap = np.maximum(0, np.maximum(self.low - q.max(axis=0), q.min(axis=0) - self.high))
        away = np.square(gap).sum(axis=1)
        order = np.argsort(away, kind="stable")
        away = away[order]
        with np.errstate(over="ignore"):
            limit = np.square(bound[rows]) * (1 + 1e-9) + 1e-12
        moved = q - self.middle
        norm = np.square(moved).sum(axis=1)
        sides = np.column_stack([-2 * moved, np.ones(len(norm)), norm * (1 - self.slack)])
        row, at, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        done, most = 0, 4 * self.block
        while done < len(order):
            left = np.searchsorted(away, limit.max() * (1 + 1e-9) + 1e-12, side="right") - done
            if left <= 0:
                break
            taken = np.cumsum(self.ends[order[done : done + left]] - self.starts[order[done : done + left]])
            some = max(1, int(np.searchsorted(taken, most, side="right")))
            blocks = order[done : done + some]
            done, most = done + some, min(CHUNK, 2 * most)
            cols = np.concatenate([np.arange(self.starts[b], self.ends[b]) for b in blocks])
            least = sides @ self.sides[cols].T
            near = least <= limit[:, None]
            if len(cols) >= k and np.count_nonzero(near) > 4 * k * len(q):
                least[code[:, None] == self.code[cols][None, :]] = np.inf
                limit = np.minimum(limit, np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * self.slack * (norm + self.farthest))
                near = least <= limit[:, None]
            i, j = np.divmod(np.flatnonzero(near), len(cols))
            j = cols[j]
            other = code[i] != self.code[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            row, at, dist = np.concatenate([row, i]), np.concatenate([at, j]), np.concatenate([dist, exact_distances(q[i], self.x[j])])
            by = np.lexsort((self.rank[at], dist, row))
            row, at, dist = row[by], at[by], dist[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kth = place == k - 1
            with np.errstate(over="ignore"):
                limit[row[kth]] = np.minimum(limit[row[kth]], np.square(dist[kth]) * (1 + 1e-9) + 1e-12)
            row, at, dist = row[place < k], at[place < k], dist[place < k]
        near = dist <= bound[rows][row] * (1 + 1e-9) + 1e-12
        return rows[row[near]], at[near], dist[near]


def _codes(*ids) -> list[np.ndarray]:
    """Numbers that are equal where ids are, missing ones included."""
    whole = pa.concat_arrays([i.combine_chunks() if isinstance(i, pa.ChunkedArray) else i for i in ids]).dictionary_encode().indices
    codes = pc.fill_null(whole, -1).to_numpy()
    return np.split(codes, np.cumsum([len(i) for i in ids])[:-1])


def _ranks(ids) -> np.ndarray:
    by = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy()
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    return rank


def _lists(n: int, row: np.ndarray, at: np.ndarray, dist: np.ndarray, data: pa.Table, vectors: bool) -> pa.Array:
    """A list of neighbours for each of ``n`` queries."""
    offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    took = data.select(["pid", "mult", "vec"]).take(pa.array(at)).combine_chunks()
    one = lambda c: took.column(c).combine_chunks() if len(at) else pa.array([], data.schema.field(c).type)
    fields = {"dist": pa.array(dist), "other": one("pid"), "mult": one("mult")} | ({"vec": one("vec")} if vectors else {})
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _near_type(vectors: bool) -> str:
    return f"array<struct<dist:double,other:string,mult:bigint{',vec:array<double>' if vectors else ''}>>"


def _own_cells(placed: DataFrame, k: int, block: int, vectors: bool) -> DataFrame:
    """Neighbours inside the own cell of every point that asks; and a row per cell with its box."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        x, (code,) = _matrix(data.column("vec")), _codes(data.column("pid"))
        asks = np.flatnonzero(data.column("asks").to_numpy())
        row, at, dist = Cell(x, code, _ranks(data.column("pid")), block).nearest(x[asks], code[asks], np.full(len(asks), np.inf), k)
        bound = np.full(len(asks), np.inf)
        last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
        bound[row[last]] = dist[last]
        out = data.select(["cls", "cell", "pid", "vec"]).take(pa.array(asks))
        nothing = pa.nulls(len(asks), pa.list_(pa.float64()))
        for name, column in (("bound", pa.array(bound)), ("near", _lists(len(asks), row, at, dist, data, vectors)), ("low", nothing), ("high", nothing)):
            out = out.append_column(name, column)
        box = pa.table({n: pa.nulls(1, out.schema.field(n).type) for n in out.column_names}).select(out.column_names)
        for name, values in (("cls", data.column("cls")[0].as_py()), ("cell", data.column("cell")[0].as_py()), ("low", x.min(axis=0).tolist()), ("high", x.max(axis=0).tolist())):
            box = box.set_column(box.column_names.index(name), out.schema.field(name), pa.array([values], out.schema.field(name).type))
        return pa.concat_tables([out.cast(box.schema), box])

    schema = f"cls int, cell int, pid string, vec array<double>, bound double, near {_near_type(vectors)}, low array<double>, high array<double>"
    return placed.groupBy("cls", "cell").applyInArrow(run, schema)


# --- visits to other cells -----------------------------------------------------


def _crossings(x: np.ndarray, own: np.ndarray, bound: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(rows, cells) of the visits: cells other than its own whose box is within ``bound`` of a row."""
    step = max(1, TESTED // max(1, len(ids)))
    for start in range(0, len(x), min(step, 1024)):
        rows = np.arange(start, min(len(x), start + min(step, 1024)))
        q, most = x[rows], bound[rows]
        # A little slack keeps rounding from hiding a tie.
        with np.errstate(over="ignore"):
            limit = np.square(most) * (1 + 1e-9) + 1e-12
        gap = np.maximum(0, np.maximum(low - q.max(axis=0), q.min(axis=0) - high))
        some = np.flatnonzero(np.square(gap).sum(axis=1) <= limit.max() * (1 + 1e-9) + 1e-12)
        away = np.zeros((len(rows), len(some)))
        for f in range(x.shape[1]):
            away += np.square(np.maximum(0, np.maximum(low[some, f][None, :] - q[:, f, None], q[:, f, None] - high[some, f][None, :])))
        i, j = np.nonzero((away <= limit[:, None]) & (ids[some][None, :] != own[rows][:, None]))
        yield rows[i], ids[some[j]]


def _visits(asking: DataFrame, cells: dict, parts: dict | None) -> DataFrame:
    """Visits to other cells, dealt to ``parts`` of each; without them the number of visits per cell."""

    def found(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, x = batch.column("cls").to_numpy(), _matrix(batch.column("vec"))
            own, bound = batch.column("cell").to_numpy(), batch.column("bound").to_numpy()
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                for rows, ids in _crossings(x[at], own[at], bound[at], *cells[int(c)]):
                    yield batch, int(c), at[rows], ids

    def count(batches):
        n: dict[tuple, int] = {}
        for _, c, _, ids in found(batches):
            for cell, times in zip(*np.unique(ids, return_counts=True), strict=True):
                n[c, int(cell)] = n.get((c, int(cell)), 0) + int(times)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in n], pa.int32()) for i in range(2)] + [pa.array(list(n.values()), pa.int64())], ["cls", "cell", "n"])

    def visit(batches):
        turn = 0
        for batch, c, rows, ids in found(batches):
            dealt = np.array([parts[c, int(i)] for i in np.unique(ids)])[np.searchsorted(np.unique(ids), ids)]
            part = (np.arange(turn, turn + len(ids)) % dealt).astype(np.int32)
            turn += len(ids)
            for start in range(0, len(rows), VISITORS):
                cut = slice(start, start + VISITORS)
                own = batch.select(["cls", "pid", "vec", "bound"]).take(pa.array(rows[cut]))
                yield own.append_column("cell", pa.array(ids[cut].astype(np.int32))).append_column("part", pa.array(part[cut]))

    own = asking.select("cls", "cell", "pid", "vec", "bound")
    if parts is None:
        return own.mapInArrow(count, "cls int, cell int, n bigint")
    return own.mapInArrow(visit, "cls int, pid string, vec array<double>, bound double, cell int, part int")


def _other_cells(asking: DataFrame, placed: DataFrame, cells: dict, k: int, block: int, most: int, vectors: bool) -> DataFrame | None:
    """Neighbours of the points whose ball reaches other cells, one row per visit that finds some."""
    counted = _visits(asking, cells, None).groupBy("cls", "cell").agg(F.sum("n").alias("n")).collect()
    if not counted:
        return None
    parts = {(r.cls, r.cell): -(-r.n // most) for r in counted}

    def copies(batches):
        """The points of visited cells, once for each part."""
        for batch in batches:
            times = np.array([parts.get(at, 0) for at in zip(batch.column("cls").to_pylist(), batch.column("cell").to_pylist(), strict=True)], np.int64)
            if not times.sum():
                continue
            rows = np.repeat(np.arange(len(times)), times)
            part = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            for start in range(0, len(rows), VISITORS):
                cut = slice(start, start + VISITORS)
                yield batch.take(pa.array(rows[cut])).append_column("d_part", pa.array(part[cut].astype(np.int32)))

    def run(asked: pa.Table, data: pa.Table) -> pa.Table:
        asked, data = asked.combine_chunks(), data.rename_columns([c.removeprefix("d_") for c in data.column_names]).combine_chunks()
        if not asked.num_rows or not data.num_rows:
            return pa.table({n: pa.nulls(0, t) for n, t in zip(("cls", "pid", "near"), (pa.int32(), pa.string(), _lists(0, *[np.zeros(0, np.int64)] * 2, np.zeros(0), data, vectors).type), strict=True)})
        x, (code, own) = _matrix(data.column("vec")), _codes(data.column("pid"), asked.column("pid"))
        row, at, dist = Cell(x, code, _ranks(data.column("pid")), block).nearest(_matrix(asked.column("vec")), own, asked.column("bound").to_numpy(), k)
        hit = np.unique(row)
        out = asked.select(["cls", "pid"]).take(pa.array(hit))
        return out.append_column("near", _lists(len(hit), np.searchsorted(hit, row), at, dist, data, vectors))

    # As many partitions as groups: small tables are searched side by side too.
    n = min(2_000, 2 * sum(parts.values()))
    names = ["cls", "vec", "pid", "mult", "cell"]
    data = placed.select(*names).mapInArrow(copies, "cls int, vec array<double>, pid string, mult bigint, cell int, d_part int")
    data = data.select(*[F.col(c).alias(f"d_{c}") for c in names], "d_part")
    group = ["cls", "cell", "part"]
    left = _visits(asking, cells, parts).repartition(n, *group).groupBy(*group)
    right = data.repartition(n, *[f"d_{c}" for c in group]).groupBy(*[f"d_{c}" for c in group])
    return left.cogroup(right).applyInArrow(run, f"cls int, pid string, near {_near_type(vectors)}")


def nearest_lists(points: DataFrame, k: int = 5, block: int = 2000, max_pivots: int = 16384, queries: DataFrame | None = None, vectors: bool = True) -> DataFrame:
    """(cls, pid, near): the k nearest distinct points of every point that has any, as a list of (dist, other, mult and, with ``vectors``, vec).

    ``queries`` (cls, pid) names the points whose neighbours are wanted, all by default.  A class is cut into cells of about 16 x ``block`` points, ``max_pivots``
    at most; a sixteenth of ``block`` is compared at once.
    """
    points = points.filter("cls is not null and vec is not null")
    points = materialise(points.select("cls", "vec", "pid", "mult"), "points")
    sizes = {r.cls: r.n for r in points.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    cell, leaf = 16 * block, max(2, block // 16)
    trees = _trees(points, sizes, cell, max_pivots)
    whole = F.lit(True)
    if queries is not None:
        named = queries.select("cls", "pid").distinct().withColumn("asks", whole)
        points = points.join(named, ["cls", "pid"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    else:
        points = points.withColumn("asks", whole)
    placed = _placed(points, trees)
    total = sum(len(t[4]) // 2 + 1 for t in trees.values()) + len(sizes)
    first = materialise(_own_cells(placed.repartition(min(2_000, 2 * total), "cls", "cell"), k, leaf, vectors), "near")
    asking = first.filter("low is null")
    own = asking.select("cls", "pid", "near").filter(F.size("near") > 0)
    cells: dict[int, list] = {}
    for r in first.filter("low is not null").select("cls", "cell", "low", "high").collect():
        cells.setdefault(r.cls, []).append((r.cell, r.low, r.high))
    boxes = {c: (np.array([v[0] for v in own_cells], np.int32), np.array([v[1] for v in own_cells]), np.array([v[2] for v in own_cells])) for c, own_cells in cells.items()}
    others = _other_cells(asking, placed, boxes, k, leaf, 2 * cell, vectors) if trees else None
    both = own if others is None else own.unionByName(others)
    return both.groupBy("cls", "pid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest_points(points: DataFrame, k: int = 5, block: int = 2000, max_pivots: int = 16384, queries: DataFrame | None = None, vectors: bool = True) -> DataFrame:
    """(cls, pid, other, dist, mult, vec): the neighbours of ``nearest_lists`` as rows, by rank ``_rn``; without ``vectors`` there is no ``vec``."""
    near = nearest_lists(points, k, block, max_pivots, queries, vectors).select("cls", "pid", F.posexplode("near").alias("_at", "_near"))
    fields = ("other", "dist", "mult", *(["vec"] if vectors else ()))
    return near.select("cls", "pid", *[F.col(f"_near.{f}").alias(f) for f in fields], (F.col("_at") + 1).cast("int").alias("_rn"))


def neighbour_slots(points: DataFrame, k: int = 5, **options) -> DataFrame:
    """Per point an array ``slots`` of its k nearest rows (dist, vec), nearest first.

    Copies of the point itself come first, at distance 0; a neighbour with
    several copies fills several slots.
    """
    lists = nearest_lists(points, k, **options)
    times = lambda n: F.least(n, F.lit(k)).cast("int")
    own = F.array_repeat(F.struct(F.lit(0.0).alias("dist"), F.col("vec").alias("vec")), times(F.col("mult") - 1))
    others = F.flatten(
        F.transform(
            F.coalesce("near", F.expr("cast(array() as array<struct<dist:double,other:string,mult:bigint,vec:array<double>>>)")),
            lambda n: F.array_repeat(F.struct(n["dist"].alias("dist"), n["vec"].alias("vec")), times(n["mult"])),
        )
    )
    queries = options.get("queries")
    wanted = points if queries is None else points.join(queries.select("cls", "pid"), ["cls", "pid"], "left_semi")
    joined = wanted.join(lists, ["cls", "pid"], "left")
    return joined.select("cls", "pid", "vec", "mult", F.slice(F.concat(own, others), 1, k).alias("slots"))
