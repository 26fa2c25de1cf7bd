"""Comparison of a Spark result with DuckDB's answer to the query's SQL."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_value, x))
    return x


def rows_of(df: DataFrame) -> list[str]:
    names = sorted(df.columns)
    return sorted(str(tuple(_value(r[c]) for c in names)) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(str(tuple(_value(r[i]) for i in order)) for r in cur.fetchall())


def same(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, want = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == names
    got = rows_of(df)
    assert len(got) == len(want)
    wrong = [x for x in zip(got, want) if x[0] != x[1]]
    assert not wrong, wrong[:3]
