"""Every registered query against its SQL counterpart."""

import os

import duckdb
import pytest

from tidemark import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or hasattr(v, "item") and isinstance(v.item(), bool):
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return f"{float(v):.5f}"
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(cell(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    made = registry.queries()[name](spark, SF)
    ours = rows(made.columns, [tuple(r) for r in made.collect()])
    sql = registry.oracle_sql().get(name)
    assert sql, "all of these can be put in SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert ours == rows(columns, result.fetchall())
