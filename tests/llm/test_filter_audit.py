"""The filter audit against a plain count of every order."""

import itertools
import random
import re

import duckdb
from solvens.llm import filter_audit, queries


def brute(rows, labels):
    first, good, toxic = {}, {}, {}
    for i, q, t in labels:
        if i is not None:
            good[i] = good.get(i) or q == 1
            toxic[i] = toxic.get(i) or t == 1
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and first[t] < i,
        }
        docs.append((s or "", {k for k, v in fails.items() if v}, bool(good.get(i)), bool(toxic.get(i))))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                redundant = sum(f in d[1] for d in own) - len(gone)
                steps.append(("".join(order), step, f, len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, o, s): (*rest, shapley[f]) for o, s, f, *rest in steps}
    return out


def some_rows(rng, n):
    kinds = ["alpha", "beta", "GAMMA", "delta", "eps#", "é\U0001f600", "zeta"]
    texts = [" ".join(rng.choice(kinds[: rng.randint(2, 7)]) + str(rng.randrange(60)) for _ in range(rng.choice([3, 30, 49, 50, 51, 90]))) for _ in range(n // 2)]
    texts += [None, "", " \t\n", "a|b", "A" * 30_000, "x y " * 20_000]
    ids = [*range(n - 4), 3, 3, None, None]
    return [(i, rng.choice(texts), rng.choice(["s", "s", "s", "t", None, ""])) for i in ids]


def compare(got, expected):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in got} == expected


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for level in filter_audit.adjacent_swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert len(seen) == len(filter_audit.adjacent_swaps(n)) + 1 == len(list(itertools.permutations(range(n))))


def test_diagram_shares_equal_subgraphs():
    even = filter_audit.Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert len(even.nodes) == 6 and even.weight[even.root] == (32, 0, 0)
    even.swap(2)
    assert len(even.nodes) == 6


def test_audit(spark):
    rng = random.Random(12)
    rows = some_rows(rng, 160)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 160, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, source string, part string, Mask int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    compare(filter_audit.audit(docs, marks).collect(), brute(rows, labels))
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    compare(filter_audit.audit(docs, marks.limit(0)).collect(), brute(rows, []))


def test_audit_sql_agrees(spark, data_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    expected = con.sql(queries.ORACLES["op12_filter_audit"])
    names = expected.columns
    got = queries.QUERIES["op12_filter_audit"](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(expected.fetchall())
