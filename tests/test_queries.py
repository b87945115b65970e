"""Every query with SQL gives the SQL's rows over the smallest tables."""

import os

import duckdb
import pytest

from lorespark.plans import core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(plain(r[c]) for c in columns) for r in df.collect())))
    rel = duck.sql(core.ORACLES[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted(map(repr, (tuple(plain(r[i]) for i in at) for r in rel.fetchall())))


def test_no_query_of_the_llm_package_is_needed():
    import ast
    from pathlib import Path

    root = Path(core.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            names = [n for node in ast.walk(ast.parse(f.read_text())) if isinstance(node, (ast.Import, ast.ImportFrom)) for n in [getattr(node, "module", None) or "", *(a.name for a in node.names)]]
            assert not any(n.startswith("lorespark.llm") for n in names), f
