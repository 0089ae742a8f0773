"""Every query with SQL against DuckDB on the same tables, rows and values."""

import glob
import os

import duckdb
import pytest

from palaver.plans import catalogue
from palaver.plans import records  # noqa: F401


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, duck, name):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    places = [d[0] for d in cursor.description]
    assert sorted(places) == columns
    theirs = sorted((tuple(plain(r[places.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert mine == theirs
