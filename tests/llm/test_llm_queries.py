"""Queries of the package: rows of the SQL where there is SQL, the documented columns elsewhere."""

import os

import duckdb
import pytest

from lorespark.llm import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": {"tbl": "string", "row_id": "bigint", "pii_type": "string", "start_pos": "int"},
    "p2_found": {"chunk_a": "string", "chunk_b": "string"},
    "p3_found": {"workspace_id": "string", "path": "string"},
    "p5_found": {"id": "string"},
    "p6_ids": {"doc_id": "bigint", "ids": "array<int>"},
    "p7_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p8_found": {"doc_id": "bigint", "level": "int"},
}
needs = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert dict(df.dtypes) == COLUMNS[name] and df.columns == list(COLUMNS[name])
    rows = [repr(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@needs
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = Q.QUERIES[name](spark, SF)
    rel = c.sql(Q.ORACLES[name])
    at = [list(rel.columns).index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
