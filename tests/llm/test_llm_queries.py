import duckdb
import pytest

from leafloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, small, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    cur = con.execute(Q.SQL[name])
    columns = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in Q.QUERIES[name](spark, small).select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, small, name):
    assert Q.QUERIES[name](spark, small).count() > 0
