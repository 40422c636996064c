import pytest
from compare import of_duckdb, of_spark

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
CORE = [n for n, q in entry.queries().items() if ".llm" not in q.__module__]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_is_its_sql(spark, name):
    got = of_spark(df := entry.queries()[name](spark, DIRECTORY))
    if name in entry.oracle_sql():
        names, want = of_duckdb(DIRECTORY, entry.oracle_sql()[name])
        assert sorted(df.columns) == names and got == want
