"""Compare registered queries with their SQL on the smallest tables."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AVAILABLE = os.path.isdir(SF)


def connect():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(v[i], 9) if isinstance(v[i], float) else v[i] for i in order) for v in values), key=repr)


def same(spark, query, sql):
    got, want = query(spark, SF), connect().sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
