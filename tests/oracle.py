"""Query results against DuckDB, as sorted rows of comparable values."""

import datetime

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(sql, sf):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(cols), sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
