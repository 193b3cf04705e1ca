"""Every registered query against its SQL counterpart on the smallest test set."""

import compare
import pytest

from annograph.catalog import ORACLES, QUERIES

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return compare.database(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
