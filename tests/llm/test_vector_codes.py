"""Codes of vectors against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from solvens.llm import queries, vector_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, label, [math.floor(scale * np.float32(x).item()) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = -(-max(len(v) for _, _, v in kept) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for k in set(own):
                members = [c[p] for c, o in zip(cut, own) if o == k]
                books[p][k] = [sum(col) // len(members) for col in zip(*members)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], {}
    for (i, label, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, label, "".join(f"{f[1]:02x}" for f in found), error))
    return sorted(((-1 if i is None else i), code, error, sums[label], digest) for i, label, code, error in out)


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int, code string, Row int"


def test_codes(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "GROUP", 16)
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    monkeypatch.setattr(vector_codes, "PARTITION", 100)
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, None]), [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, 5, [0.1] * 8) for i in range(150)]  # one vector that repeats
    rows += [(7, 2, rows[9][2]), (7, 2, rows[9][2]), (None, 1, [0.3] * 8), (600, 1, None), (601, 1, [math.nan] * 8), (602, 1, [0.1, None] * 4), (603, 1, [math.inf] + [0.0] * 7), (604, 0, [0.5] * 5), (605, 0, [])]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], SCHEMA).repartition(5)
    for entries in (16, 256):
        assert result(vector_codes.compress(df, entries=entries)) == brute(rows, entries=entries)
    assert vector_codes.compress(df.limit(0)).count() == 0


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, [rng.choice([1e6, -3e5, 2.5]) * rng.random() for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, label, v in rows], SCHEMA)
    assert result(vector_codes.compress(df, entries=8)) == brute(rows, entries=8)


def test_residents_stay(spark):
    """A round moves those parts only whose entry changed: the union keeps the owners' partitions."""
    shape = vector_codes.Shape(1, 1, 2, True, 1)
    salts = np.ones((1, 2), np.int64)
    blocks = [(k, (False, np.array([k * 10, k * 10 + 1]), np.array([[k], [k + 5]]))) for k in (0, 1)]
    state = spark.sparkContext.parallelize(blocks, 3).partitionBy(4, vector_codes._owner)
    stepped = state.mapPartitions(vector_codes._step(shape, np.array([[[0], [5]]]), salts), preservesPartitioning=True)
    moved = stepped.filter(vector_codes._moved).map(vector_codes._same).partitionBy(4, vector_codes._owner)
    both = stepped.filter(vector_codes._resident).union(moved)
    assert both.getNumPartitions() == 4
    assert sorted(r for _, (_, rows, _) in moved.collect() for r in rows.tolist()) == [1, 10]
    at = {int(r): key for key, (_, rows, _) in both.collect() for r in rows}
    assert at == {0: 0, 1: 1, 10: 0, 11: 1}


def test_codes_sql_agrees(spark, data_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{data_dir}/embeddings.parquet'")
    expected = con.sql(queries.ORACLES["op11_vector_codes"])
    names = expected.columns
    got = queries.QUERIES["op11_vector_codes"](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(expected.fetchall())
