import importlib.util
import os

import duckdb
import pytest

from leafloom import plans


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    try:
        return f"{float(v):.5g}"
    except (TypeError, ValueError):
        return repr(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, con, small, name):
    cur = con.execute(plans.SQL[name])
    columns = [c[0] for c in cur.description]
    out = plans.QUERIES[name](spark, small)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(tuple(map(_plain, r)) for r in out.select(*columns).collect()) == sorted(tuple(map(_plain, r)) for r in cur.fetchall())


def test_entry_and_registry(spark):
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).columns == ["source", "target"]
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_positions_beyond_32_bits(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM (VALUES (5::BIGINT, 1::BIGINT, 2147::INT), (6, 1, 2148), (7, 1, 100000)) t(entity_id, doc_id, start_offset)) TO '{tmp_path}/entities.parquet'")
    c.execute(f"COPY (SELECT 1::BIGINT AS doc_id, 120000::BIGINT AS n_chars) TO '{tmp_path}/documents.parquet'")
    for name in ("entities", "documents"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = {tuple(r) for r in plans.QUERIES["win_w02_lead_position"](spark, str(tmp_path)).collect()}
    assert got == set(c.execute(plans.SQL["win_w02_lead_position"]).fetchall()) == {(5, 2148000006), (6, 100000000007), (7, 120000000000)}
