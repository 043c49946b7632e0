"""A query's rows against its SQL in DuckDB, columns by name, rows in any order."""

import math

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(folder: str):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v) if not isinstance(v, (int, bool)) else int(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in data), key=repr)


def differences(df, sql: str, connection):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = connection.sql(sql)
    want = rows(found.columns, found.fetchall())
    if sorted(df.columns) != sorted(found.columns):
        return [("columns", sorted(df.columns), sorted(found.columns))]
    if len(got) != len(want):
        return [("rows", len(got), len(want)), *[(a, b) for a, b in zip(got, want) if a != b][:2]]
    return [(a, b) for a, b in zip(got, want) if a != b][:3]
