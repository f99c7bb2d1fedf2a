"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("T00:00:00", "")
    return repr(v)


def compare(df, sql: str, sf_dir: str) -> tuple[int, Counter, Counter]:
    """Number of rows, and what either side has alone."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names, rows = [d[0] for d in cursor.description], cursor.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    ours = Counter(tuple(shown(r[c]) for c in columns) for r in df.collect())
    theirs = Counter(tuple(shown(r[names.index(c)]) for c in columns) for r in rows)
    return len(rows), ours - theirs, theirs - ours
