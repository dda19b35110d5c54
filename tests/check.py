"""Compares a query's rows with its SQL's."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def same_rows(df, sql: str, sf: str) -> None:
    got = [r.asDict() for r in df.collect()]
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = [dict(zip(rel.columns, row, strict=True)) for row in rel.fetchall()]
    key = lambda r: tuple(repr(rounded(r[n])) for n in names)
    assert sorted(map(key, got)) == sorted(map(key, want))
