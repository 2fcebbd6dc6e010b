"""Holds a query's rows against its DuckDB SQL, as the driver does: columns by name, rows in any order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def difference(df, con, sql):
    """None, or what differs."""
    got = con.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} {sorted(got.columns)}"
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(got.columns, got.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    return next((f"{x} {y}" for x, y in zip(a, b, strict=True) if x != y), None)
