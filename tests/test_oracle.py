"""Every query against its DuckDB SQL on the smallest tables; those without SQL have tests in test_queries.py."""

import duckdb
import pytest

from leafmill.plans.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[map(plain, table.column(c).to_pylist()) for c in names])))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf).toArrow()
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert rows(got) == rows(want)
