"""Run a registered query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, Decimal):
        return f"dec{v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"f{0.0 if v == 0 else v!r}"
    return f"{type(v).__name__[0]}{v}"


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(cell(v) for v in row) for row in zip(*columns))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got_names, got = rows_of(df.toArrow())
    want_names, want = rows_of(con.sql(sql).arrow().read_all() if hasattr(con.sql(sql).arrow(), "read_all") else con.sql(sql).arrow())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; got {got[:2]} want {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. got {bad[0][0]} want {bad[0][1]}"
    return None
