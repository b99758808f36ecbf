import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if n in entry.catalog.queries()]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def plain(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_sql_gives(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    have = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    said = db.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(said.description)}
    assert sorted(at) == columns
    assert have == sorted(tuple(plain(r[at[c]]) for c in columns) for r in said.fetchall())
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
