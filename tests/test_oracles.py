"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from catalogue.queries import QUERIES
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = registered.queries()[name](spark, SF_DIR)
    if name in WITHOUT_SQL:
        assert df.count() > 0
    else:
        assert differences(df, duck, registered.oracle_sql()[name]) == []


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(registered.oracle_sql()) == WITHOUT_SQL
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry(spark):
    assert registered.entry(spark).columns == ["pain_theme", "cnt"]
