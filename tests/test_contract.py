"""Every named query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference

SLOW_FITS = {"pca_scores", "model_report"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_twins_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    found = difference(contract.queries()[name](spark, sf), con, contract.oracle_sql()[name])
    assert found is None, found


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql()) - SLOW_FITS))
def test_rows_only(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["source", "host", "windows", "detected", "worst"] and rows.count() > 0
