"""Running a query beside its SQL."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v: object) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def spark_rows(df) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    return cols, sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted("|".join(plain(x[i]) for i in at) for x in r.fetchall())
