"""Compare a query with its SQL on the same tables, row for row."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x):
    """A value in a form that both engines share: lists for arrays, rounded numbers."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if isinstance(x, bytearray | memoryview):
        return bytes(x)
    if hasattr(x, "as_tuple"):
        return float(f"{float(x):.9g}")
    if hasattr(x, "tzinfo") and x.tzinfo:
        return x.replace(tzinfo=None)
    return x


def differences(df, db: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the DataFrame and the SQL give the same columns and bag of rows."""
    names = sorted(df.columns)
    cursor = db.execute(sql)
    theirs = [c[0] for c in cursor.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    want = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    got = Counter(tuple(plain(row[n]) for n in names) for row in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows, SQL {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
