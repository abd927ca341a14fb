"""Compares a query with its SQL, rows as a multiset."""

import glob
import os
from collections import Counter

import duckdb


def rows(values):
    return Counter(tuple(v if not isinstance(v, float) else round(v, 9) for v in r) for r in values)


def differs(spark, sf, query, sql):
    """None, or what is different."""
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = query(spark, sf)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} and {names}"
    want, got = rows(cur.fetchall()), rows(tuple(r) for r in df.select(*names).collect())
    if want != got:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}, only there {list((want - got).items())[:2]}"
    return None
