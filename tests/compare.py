"""Compares a query's rows with DuckDB's over the same tables."""

import decimal
import glob
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def value(v):
    """Numbers to six significant digits; null and NaN alike."""
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v) + 0.0:.6g}".replace("-0", "0") if float(v) == 0 else f"{float(v):.6g}"
    return str(v)


def duck(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    cols = sorted(df.columns)
    mine = sorted(tuple(map(value, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(value(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs
