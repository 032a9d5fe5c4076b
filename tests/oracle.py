"""Compares a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def differences(df, sql: str, sf_dir: str) -> list:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    return [] if got == want else [len(got), len(want), *[x for x in zip(got, want, strict=False) if x[0] != x[1]][:3]]
