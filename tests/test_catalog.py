"""Every registered query with a check gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from solvens.plans import catalog, learning

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# Training runs are checked one by one in test_learning; SOLVENS_ALL=1 runs them here too.
SLOW = set() if os.environ.get("SOLVENS_ALL") else set(learning.QUERIES)
NAMES = sorted(n for n in catalog.all_checks() if n not in SLOW)


@pytest.fixture(scope="module")
def sql(data_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return 0.0 if v == 0 and isinstance(v, float) else v


def _sorted(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, data_dir, sql, name):
    df = catalog.all_queries()[name](spark, data_dir)
    relation = sql.sql(catalog.all_checks()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = [tuple(_plain(r[c]) for c in columns) for r in df.collect()]
    at = [relation.columns.index(c) for c in columns]
    expected = [tuple(_plain(r[i]) for i in at) for r in relation.fetchall()]
    assert _sorted(got) == _sorted(expected)


def test_checks_belong_to_queries():
    assert set(catalog.all_checks()) <= set(catalog.all_queries())
