"""Every query over the smallest tables, and against its SQL."""

import os

import duckdb
import pytest

from quarrylight import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = db.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = sorted(columns)
    own = sorted((tuple(_plain(r[c]) for c in key) for r in rows), key=str)
    want = sorted((tuple(_plain(r[columns.index(c)]) for c in key) for r in found.fetchall()), key=str)
    assert own == want
