"""Runs a query and the SQL that checks it over the same tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns: list[str], values: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What is different; empty if columns, kinds and rows are equal."""
    got = con.execute(sql)
    names, kinds = [d[0] for d in got.description], [str(d[1]) for d in got.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    same = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}
    spark = dict(df.dtypes)
    out = [f"{n}: {spark[n]} and {k}" for n, k in zip(names, kinds, strict=True) if same.get(k, spark[n]) != spark[n] or k == "HUGEINT" or k.startswith("DECIMAL")]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        out.append(f"{len(a)} and {len(b)} rows; only Spark {[x for x in a if repr(x) not in sb][:2]}; only SQL {[x for x in b if repr(x) not in sa][:2]}"[:1500])
    return out
