"""Comparison of a query's rows with its SQL's."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "None" if isinstance(v, float) and math.isnan(v) else float(v)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else str(list(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: [(x, "") if isinstance(x, float) else (0.0, x) for x in (round(x, 2) if isinstance(x, float) else x for x in r)]
    return sorted(([plain(r[i]) for i in order] for r in rows), key=key)


def same(df, relation):
    got, want = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-4)), (a, b)
