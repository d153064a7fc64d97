"""Spark results against DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    found = con.execute(sql)
    want_names = [c[0] for c in found.description]
    want = rows_of(want_names, found.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(want_names)}"
    if len(want) != len(got):
        return f"{len(got)} rows and {len(want)}; first only in one: {[r for r in got if r not in want][:2]} {[r for r in want if r not in got][:2]}" if len(got) < 3000 else f"{len(got)} rows and {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {[r for r in got if r not in want][:2]} {[r for r in want if r not in got][:2]}" if bad else ""
