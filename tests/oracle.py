"""Compares a query with its SQL on the same files, row order aside."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: bytes(v) if isinstance(v, bytearray) else tuple(map(plain, v)) if isinstance(v, list) else v + 0.0 if isinstance(v, float) else v
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in values)


def compare(spark, plan, sql, sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = plan(spark, sf), con.execute(sql)
    names = [d[0] for d in want.description]
    want_names, want_rows = rows(names, want.fetchall())
    got_names, got_rows = rows(got.columns, [tuple(r) for r in got.collect()])
    assert got_names == want_names
    extra, missing = got_rows - want_rows, want_rows - got_rows
    assert not extra and not missing, (list(extra)[:3], list(missing)[:3], sum(extra.values()), sum(want_rows.values()))
