import pytest

from chronoreel.llm import queries

from .helpers import tables


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    found = tables(sf).execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(found.fetchall())
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and len(want) > 100
