"""Compare a registered query with its SQL on DuckDB."""

import glob
import os


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def _norm(v):
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return repr(v) if isinstance(v, float) else None if v is None else str(v)


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=str)


def rows_of_sql(con, sql):
    r = con.sql(sql)
    columns = sorted(r.columns)
    index = [r.columns.index(c) for c in columns]
    return columns, sorted((tuple(_norm(x[i]) for i in index) for x in r.fetchall()), key=str)
