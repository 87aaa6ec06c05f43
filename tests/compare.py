"""Rows of a Spark query against rows of DuckDB SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((v is None, str(round(v, 3) + 0.0) if isinstance(v, float) else str(v)) for v in r))


def same(a, b, tolerance: float = 1e-9) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        a, b = float(a), float(b)
        return a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)
    return a == b


def difference(df, con, sql: str) -> str:
    """Empty if the results agree in columns and rows."""
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {df.columns} and {want.columns}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(want.columns, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    return f"{len(bad)} of {len(a)} rows differ, as {bad[0]}" if bad else ""
