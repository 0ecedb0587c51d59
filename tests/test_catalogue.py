import os

import duckdb
import pytest

from meterql import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) & set(catalogue._REPORTS)))
def test_reports_against_sql(spark, tables, name):
    got = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = tables.sql(catalogue.oracle_sql()[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = [tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)) for r in got.collect()]
    b = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want.project(", ".join(columns)).fetchall()]
    assert sorted(a, key=key) == sorted(b, key=key)
