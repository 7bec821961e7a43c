"""Each settlement query gives the rows of its SQL."""

import pytest
from oracle import of_spark, of_sql

from quillon import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert of_spark(df, columns) == of_sql(registry.SQL[name], DATA, columns)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
