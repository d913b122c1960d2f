"""Every registered query runs at the smallest scale, and agrees with its checking SQL where it has one."""
import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
# At this scale the News folder or the search terms may leave nothing to show.
MAY_BE_EMPTY = {"search"}


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    difference = compare.compare(spark, con, name, SF)
    if difference.startswith("EMPTY") and name in MAY_BE_EMPTY:
        return
    assert not difference or difference.startswith("rows only")
