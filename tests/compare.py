"""Runs a query and its DuckDB statement on the same tables and compares the rows, columns by name."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            path = f"{sf_dir}/{name}"
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(plain([row[k] for k in order]) for row in rows)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = con.sql(sql)
    columns, rows = list(got.columns), got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)
