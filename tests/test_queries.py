"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from conftest import DATA
from quern import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    got = df.collect()
    if name not in queries.oracle_sql():
        return
    r = con.sql(queries.oracle_sql()[name])
    columns = list(r.columns)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(norm(row[columns.index(c)]) for c in sorted(columns)) for row in r.fetchall())
    assert sorted(tuple(norm(row[c]) for c in sorted(columns)) for row in got) == want


def test_page_rank_of_the_whole_graph(spark, con):
    edges = con.sql("SELECT DISTINCT -l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IS NOT NULL UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 1").fetchall()
    ids = {x for e in edges for x in e}
    degree, ranks = {}, dict.fromkeys(ids, 1 / len(ids))
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    for _ in range(10):
        given = dict.fromkeys(ids, 0.0)
        for a, b in edges:
            given[b] += ranks[a] / degree[a]
        ranks = {x: 0.15 / len(ids) + 0.85 * g for x, g in given.items()}
    got = {r.id: r.rank for r in queries.queries()["page_rank"](spark, DATA).collect()}
    assert got.keys() == ids and all(math.isclose(got[x], r, rel_tol=1e-9) for x, r in ranks.items()) and min(ids) < 0
