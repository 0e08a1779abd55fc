"""Every query of the core against its SQL, over the smallest tables where they are at hand."""

import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from lodeseek.plans import catalogue

D = os.environ.get("SMOKE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.replace(tzinfo=None) if isinstance(v, datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, D)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    got = sorted((tuple(_plain(r[i]) for i in order) for r in df.collect()), key=repr)
    cur = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    assert [cols[i] for i in at] == sorted(df.columns)
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    n = catalogue.queries()[name](spark, D).count()
    assert n > 0 or name.startswith("structure_")  # the smallest tables need not hold every language


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
