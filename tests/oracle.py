"""Runs a query and its SQL over the same tables and compares rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, db, sf, run, sql):
    df = run(spark, sf)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0], (a[0], b[0])
    assert len(a[1]) == len(b[1]), (len(a[1]), len(b[1]), a[1][:3], b[1][:3])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == y, (x, y)
        assert [type(i) for i in x] == [type(i) for i in y], (x, y)
