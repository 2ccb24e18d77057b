"""Results of a query and of its DuckDB statement, made comparable."""

import decimal
import glob
import os

import duckdb


def connection(root):
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        source = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{source}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()), columns


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    rows = found.fetchall()
    columns = sorted(names)
    return sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rows), columns
