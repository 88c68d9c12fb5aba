"""Every named query against the SQL that says the same."""

import pytest
from conftest import DATA

from auditspark.plans import registry


def plain(v):
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "quantize") else v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = rows([r[names.index(c)] for c in columns] for r in result.fetchall())
    assert rows([r[c] for c in columns] for r in df.collect()) == expected


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
