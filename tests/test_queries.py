"""Registered queries against their SQL on the smallest tables, and the entry query."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from fathomflow.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.8g}") + 0.0
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    return [plain(x) for x in value] if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    expected = duck.execute(ORACLES[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(found.columns) == columns
    at = [[c[0] for c in expected.description].index(c) for c in columns]
    key = lambda r: [(x is None, str(type(x)), str(x)) for x in r]
    got = sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=key)
    want = sorted(([plain(r[i]) for i in at] for r in expected.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, int | float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
