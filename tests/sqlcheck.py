"""Run registered queries on Spark and on DuckDB and compare the results."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(out, key=_key)


def compare(df, con, sql):
    """None if equal, else a description of the first difference."""
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows; first {got[:2]} / {want[:2]}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if g != w and not all(
            a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-8) for a, b in zip(g, w)
        ):
            return f"row {g} != {w} ({got_cols})"
    return None
