"""The n-gram join against all pairs."""

import random
import re

import numpy as np
import pytest
from solvens.llm import ngram_join, queries
from solvens.llm.ngram_join import Limit


def brute(rows, limit):
    """Of each row: size of its set, smallest id of its component."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower))
        sets.append({tuple(w[k : k + limit.words]) for k in range(len(w) - limit.words + 1)} if len(w) >= limit.words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for k, a in enumerate(sets):
        if rows[k][0] is None:
            continue
        common = {}
        for g in a:
            for j in holders[g]:
                if j < k and rows[j][0] is not None:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= limit.percent * (len(a) + len(sets[j]) - c) and find(k) != find(j):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((-1 if i is None else i, len(s), -1 if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def edited(rng, text, edits, tag):
    w = text.split()
    for k in rng.sample(range(len(w)), min(edits, len(w))):
        w[k] = f"{tag}_{k}"
    return " ".join(w)


def some_rows(rng):
    prose = lambda n, kinds=300: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    base = [prose(rng.randint(1, 200)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, edited(rng, base[i % 20], rng.randint(1, 5), f"e{i}")) for i in range(150)]
    out += [(300 + i, base[3]) for i in range(40)]  # a hot class
    line = prose(30)
    out += [(400 + i, prose(rng.randint(1, 40)) + " " + line) for i in range(60)]  # a line on every page
    template = prose(120, 5000)
    out += [(500 + i, edited(rng, template, 5, f"t{i % 90}_{i}")) for i in range(120)]
    out += [(700 + i, edited(rng, template, 1, f"n{i}")) for i in range(60)]  # near copies
    out += [(800 + i, " ".join(template.split()[: 120 - i])) for i in range(30)]  # sizes at the limit
    out += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "One\ttwo"), (905, "a b c"), (906, "é \U0001f600 x y"), (907, "x " * 30_000), (908, prose(20_000, 90))]
    return out + [out[5], out[5], (7, "another text of an id that occurs twice already"), (None, base[7]), (None, None)]


@pytest.mark.parametrize("settings, limit", [({}, Limit(5, 75)), ({"HOT": 3, "POSTING": 4, "BLOCK": 2000, "LEAST_SPARE": 1}, Limit(4, 85)), ({"HOT_GRAMS": 0, "SPARE": 0, "LEAST_SPARE": 0}, Limit(5, 75))])
def test_groups(spark, monkeypatch, settings, limit):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = some_rows(random.Random(13))
    df = spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in rows], "doc_id long, text string, digest binary, node int, N int").repartition(7)
    assert result(ngram_join.similar_groups(df, limit)) == brute(rows, limit)
    assert settings or ngram_join.similar_groups(df.limit(0)).count() == 0


def test_groups_of_documents(spark, data_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert result(queries.QUERIES["op13_ngram_join"](spark, data_dir)) == brute(rows, Limit())


def test_fragment_is_long_enough():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        limit = Limit(4, int(rng.choice([75, 85])))
        both, x, y = rng.integers(1, 60), rng.integers(0, 12), rng.integers(0, 12)
        if 100 * both < limit.percent * (both + x + y) or x > y:
            continue
        order = rng.permutation(both + x + y)
        sets = np.sort(order[: both + x]), np.sort(np.r_[order[:both], order[both + x :]])
        spare, small, _ = limit.fragment(len(sets[0]))
        large = limit.fragment(len(sets[1]))[2]
        assert len(np.intersect1d(sets[0][:small], sets[1][:large])) >= min(spare, both)
