import os

import duckdb
import pandas as pd
import pytest
from lodestone.plans import reports

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if pd.isna(x) else (int(x) if not isinstance(x, str) and float(x).is_integer() else x)
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(reports.QUERIES))
def test_query_equals_sql(spark, sf, db, name):
    got, want = reports.QUERIES[name](spark, sf).toPandas(), db.sql(reports.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["path", "kind", "count"]
