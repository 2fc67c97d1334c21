"""The same query by Spark and by DuckDB."""

import glob
import os
from datetime import datetime

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{base}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same(df, con, sql: str) -> tuple[list, list]:
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    ours = sorted([plain(r[c]) for c in columns] for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted([plain(r[i]) for i in at] for r in rel.fetchall())
    return ours, theirs
