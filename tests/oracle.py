"""Spark query against DuckDB SQL over the same tables."""

import math
import os

import duckdb


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*cols).collect())
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    want = sorted(repr(tuple(plain(x) for x in r)) for r in rel.project(",".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want
