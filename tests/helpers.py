"""Comparison of DataFrames with DuckDB's answers."""

import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def _value(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def assert_matches(df, sql, sf_dir=SMALL):
    columns, rows = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    assert len(got) == len(want)
    assert got == want
