"""Comparison of a query with its SQL on the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted(repr(tuple(None if pd.isna(v) else v for v in r)) for r in frame[names].astype(object).itertuples(index=False, name=None))


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con.sql(sql).df()
