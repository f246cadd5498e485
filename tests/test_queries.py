"""The registered queries over the request log against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"
OWN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", OWN)
def test_same_as_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name]) == ""


def test_flagship(spark):
    assert entry.entry(spark).columns


def test_every_query_has_sql():
    own = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    assert sorted(own) == sorted(OWN)
