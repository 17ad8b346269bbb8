"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import decimal
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


def assert_same(df, con, sql):
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    assert ours == theirs
