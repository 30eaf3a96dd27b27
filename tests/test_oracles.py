"""Every registered query of the reference's operators against its SQL."""

import os

import duckdb
import pytest

from cadenza.plans import file_queries, manifest_queries
from cadenza.plans import queries as Q

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(v[i]) for i in order) for v in values)


QUERIES = {n: (f, m.oracle_sql()[n]) for m in (Q, manifest_queries, file_queries) for n, f in m.queries().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    run, sql = QUERIES[name]
    got = run(spark, SF_DIR)
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    for m in (Q, manifest_queries, file_queries):
        assert set(m.queries()) == set(m.oracle_sql())
