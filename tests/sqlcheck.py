"""Compares a query's rows with those of its SQL in DuckDB, order and column order aside."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(data=None):
    con = duckdb.connect()
    for f in (data or DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


def compare(spark, query, sql, data=None):
    df = query(spark, str(data or DATA))
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = connect(data).execute(sql)
    theirs_names = [d[0] for d in rel.description]
    theirs = sorted(tuple(plain(r[theirs_names.index(c)]) for c in names) for r in rel.fetchall())
    assert sorted(theirs_names) == names
    assert mine == theirs
