"""Shared by the query tests: runs a query's SQL in DuckDB and compares rows."""

import glob
import os

import pandas as pd

DATA = "/root/testdata/sf0.001"


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(df: pd.DataFrame) -> list:
    def one(v):
        if hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None if v != v else round(float(v), 6) + 0.0
        if v is pd.NaT or v is pd.NA:
            return None
        return v

    cols = sorted(df.columns)
    return sorted((tuple(map(one, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def assert_same(spark, con, query, sql):
    got, want = query(spark, DATA).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
