"""Runs a query and its SQL twin and compares them as unordered multisets."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    cur = con.execute(sql)
    want_columns, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != got_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    if not want:
        return "no rows"
    for w, g in zip(want, got):
        if w != g or [type(a) for a in w] != [type(a) for a in g]:
            return f"{g} instead of {w}"
    return None
