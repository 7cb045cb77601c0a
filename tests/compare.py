"""Rows and types of a query against those of its SQL twin in DuckDB."""

import glob
import math
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        source = p if Path(p).is_file() else f"{p}/*.parquet"
        c.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{source}'")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


def differences(df, sql, connection):
    theirs = connection.sql(sql)
    names = sorted(df.columns)
    if names != sorted(theirs.columns):
        return f"columns {names} and {sorted(theirs.columns)}"
    own, other = dict(df.dtypes), dict(zip(theirs.columns, map(str, theirs.types)))
    kinds = [(n, own[n], other[n]) for n in names if KINDS.get(own[n], own[n].upper()) != other[n]]
    if kinds:
        return f"types {kinds}"
    a = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    at = [theirs.columns.index(n) for n in names]
    b = sorted(tuple(_plain(r[i]) for i in at) for r in theirs.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{len(a)} and {len(b)} rows; only here or there: {only}"
    return None
