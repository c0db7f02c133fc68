"""Runs a registered query and its DuckDB twin over the same tables and compares all rows."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = Counter(tuple(plain(v) for v in r) for r in df.select(columns).collect())
    told = con.execute(sql)
    names = [c[0] for c in told.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in told.fetchall())
    assert found == want, (list((found - want).items())[:3], list((want - found).items())[:3])
    return sum(found.values())
