"""Comparison of a query with its SQL, as multisets of rows with sorted columns."""

import math
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = con.execute(sql)
    names, kinds = [c[0] for c in found.description], {c[0]: str(c[1]) for c in found.description}
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert {c: KINDS[k] for c, k in df.dtypes if k in KINDS} == {c: kinds[c] for c, k in df.dtypes if k in KINDS}
    assert got == want
