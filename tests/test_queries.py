"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from normgraph import queries
from normgraph.plans import tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def _plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else "null" if x is None else str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def test_each_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, found.fetchall())


def test_tables_of_operators_can_be_deleted(spark):
    df = tables.stash(spark.range(3), "some")
    assert df.count() == 3
    tables.forget_all(spark)
    assert not tables._made
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        df.collect()
