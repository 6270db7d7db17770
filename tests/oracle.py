"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if type(x).__name__ in ("Decimal", "int64", "float64"):
        return plain(float(x))
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    if hasattr(x, "replace") and hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    where = [rel.columns.index(c) for c in names]
    return names, Counter(tuple(plain(r[i]) for i in where) for r in rel.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{c}`" for c in names)).collect())
