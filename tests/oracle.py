"""Holds a query's rows against those of its DuckDB SQL."""

import datetime
import glob
import os

import duckdb

from saltmarsh.schemas import configured  # noqa: F401


def views(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return float(value)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    told = con.sql(sql)
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(r[k]) for k in at)) for r in told.fetchall())
    assert ours == theirs
