import duckdb
import pytest

import __spark_entry__ as entry
from chronoreel.plans import catalog
from chronoreel.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got and got == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
