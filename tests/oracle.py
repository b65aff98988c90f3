"""Runs a query and its oracle SQL and compares the rows, as the driver does."""

import os

import duckdb

from hirelake.sources.tables import TABLES


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: repr(round(v, 6) if isinstance(v, float) else float(v) if type(v).__name__ == "Decimal" else v)
    return sorted(tuple(text(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want, [x for x in zip(got, want, strict=True) if x[0] != x[1]][:3]
    return len(got)
