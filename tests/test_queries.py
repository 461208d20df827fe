"""Every query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from cairnfield.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    if name not in catalogue.SQL:
        df.collect()
        return
    want = con.sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
