"""Small fixtures, and the comparison of a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def oracle(sql, sf=SF, **views):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name, frame in views.items():
        con.register(f"_{name}", frame)
        con.sql(f"CREATE OR REPLACE VIEW {name} AS FROM _{name}")
    return con.sql(sql).df()


def same(df, sql, sf=SF, **views):
    want = oracle(sql, sf, **views)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    key = lambda frame: sorted(map(repr, frame[names].astype(object).itertuples(index=False, name=None)))
    got, want = key(df.toPandas()), key(want)
    assert got == want
    return len(got)
