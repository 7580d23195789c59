"""Every registered query against its check text on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_names_agree():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, text, _ = compare(spark, duck, name, QUERIES[name], CHECKS.get(name), SF)
    assert verdict in ("ok", "rows"), text
