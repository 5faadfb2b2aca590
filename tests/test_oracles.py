"""Every registered query agrees with its oracle SQL on the smallest tables."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
NAMES = list(queries())


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = compare.compare(spark, con, name, FOLDER)
    assert ok, note


def test_every_oracle_has_a_query(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() == 6
