"""Queries that have an SQL counterpart, on the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered
from forumlens.llm.oracles import ORACLES
from tests.oracle import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert differences(registered.queries()[name](spark, SF_DIR), duck, ORACLES[name]) == []


def test_one_query_per_operator_and_the_pipeline():
    names = set(registered.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
