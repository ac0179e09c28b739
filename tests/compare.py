"""Compares a query's rows with its SQL on DuckDB, as multisets of values by column name."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    def value(x):
        if hasattr(x, "item") and getattr(x, "ndim", 0) == 0:
            x = x.item()
        return round(x, 9) if isinstance(x, float) else x

    return sorted(repr([value(x) for x in r]) for r in rows)


def same(spark, con, folder, query, sql):
    found, wanted = query(spark, folder), con.sql(sql)
    names = sorted(found.columns)
    assert names == sorted(wanted.columns)
    ours = plain([r[c] for c in names] for r in found.collect())
    theirs = plain([r[wanted.columns.index(c)] for c in names] for r in wanted.fetchall())
    assert ours == theirs
