"""Every registered query against its SQL twin at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from scripts.check_oracle import compare, connect

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    state, text = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert state != "BAD", text
    assert "TYPES" not in text, text


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
