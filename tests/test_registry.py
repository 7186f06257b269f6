"""Every registered query against its SQL twin on the smallest test set."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck_rows, spark_rows
from tests.conftest import SF_DIR

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, duck, key):
    columns, rows = spark_rows(QUERIES[key](spark, SF_DIR))
    if key not in ORACLES:
        assert rows
        return
    expected_columns, expected = duck_rows(duck, ORACLES[key])
    assert columns == expected_columns
    assert rows == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns and df.limit(1).count() == 1
