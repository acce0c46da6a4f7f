"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("boolean", "BOOLEAN"), ("timestamp_ntz", "TIMESTAMP")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    wanted = duck.sql(registry.oracle_sql()[name])
    columns = sorted(wanted.columns)
    assert sorted(df.columns) == columns
    kinds = dict(zip(wanted.columns, map(str, wanted.types), strict=True))
    assert all((k, kinds[c]) in KINDS for c, k in df.dtypes), (df.dtypes, kinds)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    expected = sorted(([plain(r[wanted.columns.index(c)]) for c in columns] for r in wanted.fetchall()), key=repr)
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
