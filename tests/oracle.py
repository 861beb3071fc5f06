"""Comparison of a query's rows with DuckDB's on the same tables, without order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    if hasattr(v, "hour"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in data)
