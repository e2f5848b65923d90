import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_equals_its_sql(same_rows, name):
    same_rows(QUERIES[name], SQL[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["lang", "term", "n", "z"]
    assert set(QUERIES) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
