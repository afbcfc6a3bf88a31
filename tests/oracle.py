"""Runs a query and its SQL side by side."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def differences(df, con, sql):
    """Rows that only one side has; also checks the column names."""
    got = df.collect()
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns), (sorted(df.columns), sorted(rel.columns))
    order = [rel.columns.index(c) for c in df.columns]
    a = Counter(tuple(map(plain, r)) for r in got)
    b = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    return list((a - b).items())[:3], list((b - a).items())[:3], len(got)
