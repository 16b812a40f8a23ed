"""Every registered analytics query against its SQL in DuckDB on the smallest tables."""

import os

import pytest
from oracle_check import compare, connect

from cairn.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, name, SF, registry.QUERIES[name], registry.SQL.get(name))
    spark.catalog.clearCache()
    assert not said.startswith("FAIL"), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
