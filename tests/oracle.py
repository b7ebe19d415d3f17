"""Run a registered query and its SQL side by side and say how they differ."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
    benchmark labels conversations""".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: str) -> str:
    t = str(t)
    return {"large_string": "string"}.get(t, "timestamp" if t.startswith("timestamp") else t)


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(v + 0.0))
    return (1, str(v))


def rows_of(arrow, names):
    cols = [arrow.column(n).to_pylist() for n in names]
    return sorted(tuple(_cell(v) for v in row) for row in zip(*cols))


def differences(df, con, sql: str) -> list[str]:
    got = df.toArrow()
    want = con.sql(sql).to_arrow_table()
    out = []
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return [f"columns {sorted(set(names) ^ set(want.column_names))}"]
    for n in names:
        a, b = _kind(got.schema.field(n).type), _kind(want.schema.field(n).type)
        if a != b:
            out.append(f"type of {n}: {a} != {b}")
    if got.num_rows != want.num_rows:
        return [*out, f"rows {got.num_rows} != {want.num_rows}"]
    a, b = rows_of(got, names), rows_of(want, names)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        shown = [(n, p[1], q[1]) for n, p, q in zip(names, x, y) if p != q][:6]
        out.append(f"{len(bad)} of {len(a)} rows differ, first: {shown}")
    return out
