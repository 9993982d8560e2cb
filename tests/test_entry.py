"""The driver's contract: queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*columns).collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.execute(f"select {', '.join(columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(map(repr, want))
