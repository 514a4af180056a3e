"""Every query with an oracle against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from weir.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame):
    return sorted(tuple("~" if pd.isna(x) else str(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = pd.DataFrame(cursor.fetchall(), columns=names)
    got = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns)
    assert sorted(got.columns) == sorted(names)
    assert len(got) == len(want) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
