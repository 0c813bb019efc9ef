"""Spark results against DuckDB's."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def check(spark, name, query, sql, data=DATA):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == cols, name
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in done.fetchall()), key=repr)
    assert got == want, name
