from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tests.compare import differences, oracle

FOLDER = contract.SMOKE_FOLDER


@pytest.fixture(scope="module")
def duck():
    return oracle(FOLDER)


def test_contract(spark):
    assert set(contract.QUERIES) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", contract.QUERIES)
def test_query_equals_sql(spark, duck, name):
    rows, found = differences(contract.queries()[name](spark, FOLDER), duck, contract.oracle_sql()[name])
    assert rows > 0
    assert not found
