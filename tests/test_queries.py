"""Every registered query with SQL, against DuckDB."""

import os

import duckdb
import pytest

from gleaner.plans import registry
from tools.compare import canonical


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.ORACLE_SQL[name])
    want, columns = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(got, df.columns) == canonical(want, columns)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"session_id", "pixel_hash", "hash_algorithm", "file_count"}
