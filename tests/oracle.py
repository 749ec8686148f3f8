"""Rows of a query against those of its SQL twin."""

import glob
import os
from collections import Counter

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v) if isinstance(v, list) else v


def differences(df, sql, folder):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    theirs = Counter(tuple(map(_plain, r)) for r in want.fetchall())
    ours = Counter(tuple(map(_plain, r)) for r in df.select(*names).collect())
    return ours - theirs, theirs - ours
