"""Training-data queries that SQL can express, against that SQL."""

import pytest
from conftest import DATA

from auditspark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    result = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())


def test_names():
    assert set(Q.oracle_sql()) <= set(Q.queries())
    assert [n for i in range(1, 14) for n in Q.queries() if n.startswith(f"op{i}_")] == list(Q.queries())
