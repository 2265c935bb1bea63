"""Connected components against union-find, and the tasks that a small graph takes."""

import random

import pytest

from solvens.llm import components as module


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent if root(x) != x}


def graphs():
    rng = random.Random(3)
    path = list(range(120))
    rng.shuffle(path)
    return [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(rng.randrange(300), rng.randrange(300)) for _ in range(160)], [(i, 99) for i in range(98)], list(zip(path, path[1:], strict=False))]


@pytest.mark.parametrize("size", [1 << 15, 40])
def test_components(spark, size, monkeypatch):
    monkeypatch.setattr(module, "EDGES", size, raising=False)
    for edges in graphs():
        got = [(r.u, r.v) for r in module.components(spark.createDataFrame(edges, "u long, v long")).collect()]
        assert len(got) == len(set(got)) and dict(got) == brute(edges)


def test_small_graphs_take_few_tasks(spark):
    """However many shuffle partitions there are, and though none of them is merged."""
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    edges = spark.createDataFrame(graphs()[-1], "u long, v long").coalesce(1)
    sc, group = spark.sparkContext, "test-components"
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        module.components(edges).collect()
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
        infos = [tracker.getStageInfo(s) for s in stages]
        assert 0 < sum(i.numCompletedTasks for i in infos if i) <= 200
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
