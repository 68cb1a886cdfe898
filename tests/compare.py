"""Run registered queries against their SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

DATA = os.environ.get("CLADEWISE_DATA", "/root/testdata/sf0.001")


def duck(where: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(where)):
        path = f"{where}/{name}" + ("/*.parquet" if os.path.isdir(f"{where}/{name}") else "")
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None or isinstance(x, bool | str):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, int):
        return x
    x = float(x)
    return "nan" if math.isnan(x) else float(f"{x:.9g}")


def rows(names: list[str], data: list) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(spark, query, sql: str, where: str) -> int:
    df = query(spark, where)
    got = rows(df.columns, df.collect())
    rel = duck(where).execute(sql)
    names = [d[0] for d in rel.description]
    want = rows(names, rel.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    assert got == want, [(a, b) for a, b in zip(got, want, strict=True) if a != b][:3]
    return len(got)
