"""Runs a query and its SQL side by side: same columns, same multiset of values."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def compare(spark, name, query, sql, sf_dir, con=None):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = (con or connect(sf_dir)).execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names, f"{name}: columns {names} and {sorted(cols)}"
    at = [cols.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    more, less = ours - theirs, theirs - ours
    assert not more and not less, f"{name}: {sum(ours.values())} and {sum(theirs.values())} rows; only ours {list(more)[:3]}; only SQL {list(less)[:3]}"
    return sum(ours.values())
