import os

import pytest
from oracle import DATA, compare

from notemill.llm.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_problem_has_a_query():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 7, 10)} <= names and any(n.startswith("p8_") for n in names) and any(n.startswith("p9_") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names
