"""Every registered query of the plans against its SQL on the smallest tables, where those are at hand."""

import os

import duckdb
import pytest

from seqloom.plans import registered

DIR = os.environ.get("SEQLOOM_TABLES", "/root/testdata/sf0.001")
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registered()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    found = QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    answer = oracle.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
