"""Every registered query against its SQL counterpart at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from queries import REGISTRY
from tools.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
# Queries of the optional part have tests of their own.
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    problem = compare(contract.queries()[name](spark, SMALL), con, ORACLE[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert contract.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "entity" and df.count() > 0
