"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple("\0" if v is None else repr(v) if not isinstance(v, float) else f"{v:.12g}" for v in row)


def differences(spark, folder: str, query, sql: str, con=None) -> list[str]:
    """What differs: columns, types, counts or the first few rows."""
    df = query(spark, folder)
    rel = (con or connect(folder)).sql(sql)
    names, theirs = sorted(df.columns), sorted(rel.columns)
    if names != theirs:
        return [f"columns {names} and {theirs}"]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "timestamp": "TIMESTAMP"}
    types, out = dict(zip(rel.columns, map(str, rel.types))), []
    out += [f"type of {c}: {t} and {types[c]}" for c, t in df.dtypes if kinds.get(t, t) != types[c] and not types[c].startswith("TIMESTAMP")]
    mine = sorted(_key(tuple(r)) for r in df.select(*names).collect())
    other = sorted(_key(r) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if len(mine) != len(other):
        out.append(f"rows {len(mine)} and {len(other)}")
    same = [a == b for a, b in zip(mine, other)]
    if not all(same):
        out += [f"{a} and {b}" for a, b in zip(mine, other) if a != b][:3]
    return out


def nearly(a: float, b: float, places: int = 9) -> bool:
    return math.isclose(a, b, abs_tol=10**-places)
