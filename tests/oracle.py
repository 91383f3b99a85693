"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


def differences(df, con, sql: str) -> list[str]:
    names = sorted(df.columns)
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != names:
        return [f"columns {names} and {sorted(theirs)}"]
    kinds = dict(zip(theirs, [str(d[1]) for d in cur.description], strict=True))
    found = [f"{c}: {k} and {kinds[c]}" for c, k in df.dtypes if KINDS.get(k, k) != kinds[c]]
    want = Counter(tuple(plain(r[theirs.index(c)]) for c in names) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    if want != got:
        found.append(f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}")
    return found
