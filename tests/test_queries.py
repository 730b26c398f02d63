"""Every query against its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from framelake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    sql = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(sql.columns)
    sql = sql[ours.columns]
    for c in ours.columns:
        if ours[c].dtype.kind in "if" or sql[c].dtype.kind in "if":
            ours[c], sql[c] = ours[c].astype(float), sql[c].astype(float)
    assert rows(ours) == rows(sql)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_entry(spark):
    assert entry_module.entry(spark).count() == 516
    assert set(catalog.QUERIES) <= set(entry_module.queries())
    assert set(catalog.SQL) <= set(entry_module.oracle_sql())
