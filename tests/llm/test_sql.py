"""The queries that have SQL, against it, over whole small tables."""

import duckdb
import pytest

from cadenza.llm import queries as Q
from tests.test_oracles import SF_DIR, rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF_DIR), c.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
