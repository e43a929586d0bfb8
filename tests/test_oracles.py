"""Every query with SQL gives the rows of that SQL."""

import pytest

from mosaica import catalog


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df.select([f"`{c}`" for c in cols]).collect()), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, tables, data, name):
    cols, got = rows(catalog.QUERIES[name](spark, data))
    r = tables.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=str)
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
