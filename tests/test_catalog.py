"""Every catalogued query against its SQL in DuckDB, and those without SQL for rows."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

from stockloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def _sorted(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", [n for n in catalog.CATALOG if catalog.CATALOG[n].sql])
def test_matches_sql(spark, duck, name):
    out = catalog.run(name, spark, FOLDER)
    result = duck.execute(catalog.sql(name))
    names = [c[0] for c in result.description]
    assert sorted(out.columns) == sorted(names)
    assert _sorted(out.select(*names).collect()) == _sorted(result.fetchall())


@pytest.mark.parametrize("name", [n for n in catalog.CATALOG if not catalog.CATALOG[n].sql and not n.startswith("ml_")])
def test_has_rows(spark, name):
    assert catalog.run(name, spark, FOLDER).take(1)
