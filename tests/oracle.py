"""Run a registered query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "∅" if math.isnan(value) else (str(int(value)) if value == int(value) else f"{value:.6g}")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canon(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """'' when equal, else what differs first."""
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = rows_of(want_names, cursor.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(want_names)}"
    if len(want) != len(have):
        return f"rows {len(have)} vs {len(want)}"
    for a, b in zip(have, want):
        if a != b:
            bad = [(n, x[:150], y[:150]) for n, x, y in zip(sorted(want_names), a, b) if x != y]
            return f"first difference {bad[:3]}"
    return ""
