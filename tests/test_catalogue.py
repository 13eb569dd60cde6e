"""Every query of the catalogue against its oracle on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from skarn.plans import catalogue

duckdb = pytest.importorskip("duckdb")
DIR = entry.SMOKE_DIR
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.ORACLE:
        c = oracle.execute(catalogue.ORACLE[name])
        columns = [d[0] for d in c.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == table(columns, c.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
