"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

import datetime
import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.date, datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(map(plain, r)) for r in frame[cols].astype(object).itertuples(index=False))
