"""Runs a query and its SQL, and compares the rows without regard to order."""

import math
import os

import duckdb
import numpy as np


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return int(x)
    if isinstance(x, (float, np.floating)):
        return int(x) if float(x).is_integer() else round(float(x), 6)
    return str(list(x)) if isinstance(x, (list, np.ndarray)) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
