"""Runs a query and its SQL on the same tables and compares rows as multisets."""

import math
import os

import duckdb
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, pd.Timestamp):
        return str(value.tz_localize(None) if value.tzinfo else value)
    return value


def rows_of(frame, columns):
    return sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


def compared(spark, folder, query, sql):
    """(columns of both, rows of both)."""
    ours = query(spark, folder)
    theirs = connection(folder).execute(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    return rows_of(ours.toPandas(), columns), rows_of(theirs, columns)
