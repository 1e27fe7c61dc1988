"""Comparison of a query's rows with those of its SQL counterpart in DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_cell(y) for y in x)
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    return round(x, 6) if isinstance(x, float) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(_cell(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


def assert_same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
