"""Every query with an SQL twin gives the same rows as the twin."""

from __future__ import annotations

import pytest
from compare import compare, oracle_connection
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, con, name):
    if name not in oracle_sql():
        assert queries()[name](spark, SMALL).count() > 0
        return
    problem = compare(spark, con, SMALL, name, queries()[name], oracle_sql()[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry(spark).count() == 1000


def test_twins_have_queries():
    assert set(oracle_sql()) <= set(queries())
