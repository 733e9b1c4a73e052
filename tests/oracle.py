"""Compares queries with their SQL in DuckDB: column names, row counts and values, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{source}')")
    return con


def _plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    return x


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))


def differences(df, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names, expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got_names, got = rows_of(df.columns, df.collect())
    if names != got_names:
        return [f"columns {got_names} instead of {names}"]
    out = [] if len(got) == len(expected) else [f"{len(got)} rows instead of {len(expected)}"]
    out += [f"{g} instead of {e}" for g, e in zip(got, expected, strict=False) if g != e]
    return out
