"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(round(v, 9) + 0.0))
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, decimal.Decimal):
        return (1, str(v.normalize()))
    if isinstance(v, datetime.datetime):
        return (1, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dict):
        return (1, str(sorted((k, _plain(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return (1, str([_plain(x) for x in v]))
    return (1, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    """None if both agree, else what differs first."""
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in found.description], found.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} and {want_columns}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"{len(got)} and {len(want)} rows; only in Spark {str(a)[:600]}; only in SQL {str(b)[:600]}"
    return None
