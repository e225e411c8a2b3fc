"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in data)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf_dir).execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns), name
    want = rows(names, cur.fetchall())
    assert len(got) == len(want), (name, len(got), len(want))
    assert got == want, (name, next((a, b) for a, b in zip(got, want, strict=True) if a != b))
    return len(got)
