"""Rows of a query from Spark and from DuckDB, made comparable."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def connect():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql):
    r = con.sql(sql)
    columns = sorted(r.columns)
    at = [r.columns.index(c) for c in columns]
    return columns, sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())
