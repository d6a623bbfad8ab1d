"""Runs a registered query and its SQL side by side and compares rows without regard to order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0 if v != int(v) or abs(v) > 1e15 else int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(_cell, v))
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for _, x in sorted(v.asDict().items()))
    if isinstance(v, dict):
        return tuple(_cell(x) for _, x in sorted(v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir) -> str:
    """Empty if equal, else what differs."""
    got = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(got.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(names)}"
    want = rows_of(names, cur.fetchall())
    have = rows_of(got.columns, got.collect())
    if have == want:
        return ""
    odd = [x for x in have if x not in set(map(lambda y: y, want))][:2] if len(have) < 3000 else next(((a, b) for a, b in zip(have, want) if a != b), None)
    lost = [x for x in want if x not in set(have)][:2] if len(have) < 3000 else ""
    return f"{name}: {len(have)} and {len(want)} rows; only ours {str(odd)[:400]}; only SQL {str(lost)[:400]}"
