"""Comparing a Spark result with one of DuckDB."""

import glob
import os

import numpy as np
import pandas as pd


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, list | tuple | np.ndarray):
        return str([plain(v) for v in x])
    if isinstance(x, bool | np.bool_):
        return str(bool(x))
    if isinstance(x, int | float | np.integer | np.floating):
        return None if x != x else f"{float(x):.9g}"
    return str(x)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted([tuple(plain(v) for v in r) for r in df.itertuples(index=False)], key=str)


def duck(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con
