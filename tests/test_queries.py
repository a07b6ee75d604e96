"""Every registered query against its SQL, on the whole small tables."""

import compare
import pytest

import __spark_entry__ as entry
from tidegauge.queries import catalog

# The corpus queries have tests of their own, beside their operators.
QUERIES = dict(catalog.QUERIES)
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert name in SQL
    assert compare.differences(df, con, SQL[name]) == []


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_packet_ids_are_unique(spark, sf_dir):
    from tidegauge import fixtures

    ids = fixtures.packets(spark, sf_dir).select("packet_id")
    assert ids.count() == ids.distinct().count()
