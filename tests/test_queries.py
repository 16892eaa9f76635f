"""Every site query beside its SQL on small tables; skipped where the tables aren't there."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from pagewarden.plans import queries as site

FOLDER = os.environ.get("TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def test_every_query_is_registered():
    assert set(site.QUERIES) <= set(entry.queries()) and set(site.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "n_links", "n_pages"]


@pytest.mark.parametrize("name", sorted(site.QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("pages", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = site.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({site.ORACLES[name]})").fetchall()
    order = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert order(tuple(r) for r in found.select(*columns).collect()) == order(theirs)
