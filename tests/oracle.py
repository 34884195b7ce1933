"""Comparing a Spark result with DuckDB's answer over the same tables."""

import datetime
import decimal
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(folder=SF):
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return None if value is None else str(value)


def assert_same(df, con, sql):
    want = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    expected = sorted(([plain(row[k]) for k in at] for row in want.fetchall()), key=str)
    assert sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str) == expected
