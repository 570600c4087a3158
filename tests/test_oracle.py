"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows(df):
    cols = sorted(df.columns)

    def plain(v):
        if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return (int(v) if float(v).is_integer() else round(float(v), 6)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return cols, sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    got, want = rows(entry.queries()[name](spark, SF).toPandas()), rows(db.sql(entry.oracle_sql()[name]).df())
    assert want[1], "its SQL gives no row to compare with"
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
