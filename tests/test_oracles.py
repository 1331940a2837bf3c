"""Every registered query against its oracle."""

import pytest
from compare import database, difference

import __spark_entry__ as entry
from reviewflow.plans import oracle
from reviewflow.plans import queries as registered

ORACLES = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_mid):
    return database(sf_mid)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_mid, con, name):
    assert difference(entry.queries()[name](spark, sf_mid), con, ORACLES[name]) is None


def test_every_query_has_an_oracle():
    assert set(registered.queries()) == set(oracle.oracle_sql())


def test_entry_gives_rows(spark):
    rows = entry.entry(spark).collect()
    assert {r.sentiment for r in rows} == {"neg", "neu", "pos"}
    assert sum(r.reviews for r in rows) == 500
