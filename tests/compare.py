"""Compare a Spark result with DuckDB SQL over the same parquet tables, order-insensitively."""

from __future__ import annotations

import datetime
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    return v


FAMILY = {
    "bigint": "int64", "long": "int64", "int": "int32", "integer": "int32", "double": "double", "float": "float",
    "varchar": "string", "string": "string", "date": "date", "boolean": "boolean", "timestamp": "timestamp",
    "hugeint": "int128", "smallint": "int16",
}


def family(t: str) -> str:
    t = t.lower()
    if t.startswith("array<"):
        return family(t[6:-1]) + "[]"
    if t.endswith("[]"):
        return family(t[:-2]) + "[]"
    return FAMILY.get(t, t)


def compare(df, con, sql: str) -> list[str]:
    """Problems found; empty when rows, column names, types and values agree."""
    problems = []
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    want = res.fetchall()
    got = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    kinds = dict(df.dtypes)
    for n, t in zip(names, types):
        if family(kinds[n]) != family(t):
            problems.append(f"type of {n}: {kinds[n]} != {t}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    at = [names.index(c) for c in df.columns]
    a = Counter(tuple(_norm(v) for v in r) for r in got)
    b = Counter(tuple(_norm(r[i]) for i in at) for r in want)
    if a != b:
        x, y = list((a - b).items()), list((b - a).items())
        problems.append(f"{len(x)} rows only in Spark, {len(y)} only in DuckDB; {x[:2]} vs {y[:2]}")
    return problems
