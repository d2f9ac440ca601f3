"""Compares a query with its SQL as sets of rows."""

import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, query, sql, sf):
    df = query(spark, sf)
    names = sorted(df.columns)
    own = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=str)
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    out = db.execute(sql)
    found = [d[0] for d in out.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)
