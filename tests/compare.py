"""Comparison of a Spark result with a DuckDB result, whatever the order of rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    """Kinds that both engines have; dates are compared as text."""
    if isinstance(v, bool) or v is None or isinstance(v, (int, float, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else str(v)


def _order(row):
    """Rows in the order of what is exact in them, then of floats to six digits."""
    exact = tuple((v is None, type(v).__name__, v if not isinstance(v, float) and v is not None else 0) for v in row)
    return exact, tuple(f"{v:.6g}" if isinstance(v, float) else "" for v in row)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=_order)


def same(a, b):
    """Equal, floats to a relative 1e-9. ``a`` is the library's: it has null where SQL has null or NaN, and never NaN itself."""
    if isinstance(b, float) and math.isnan(b):
        return a is None
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def differing(got, want):
    """The rows of two sorted lists that are not the same, at most ten."""
    out = [(a, b) for a, b in zip(got, want) if not same(a, b)][:10]
    return out or ([("rows", len(got), len(want))] if len(got) != len(want) else [])


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    return rows(columns, cursor.fetchall())
