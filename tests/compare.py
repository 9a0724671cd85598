"""Compare a Spark result with DuckDB's, as multisets of rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def kind(dtype: str) -> str:
    dtype = dtype.lower()
    return {"integer": "int", "int32": "int", "bigint": "bigint", "varchar": "string"}.get(dtype, dtype)


def check(spark, con, build, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """The number of rows, and what differs."""
    mine = build(spark, sf_dir)
    theirs = con.sql(sql)
    problems = []
    my_types = {f.name: kind(f.dataType.simpleString()) for f in mine.schema.fields}
    their_types = {c: kind(str(t)) for c, t in zip(theirs.columns, theirs.types)}
    if my_types != their_types:
        problems.append(f"types: {my_types} and {their_types}")
    a = mine.toPandas()
    b = theirs.df()
    if len(a) != len(b):
        problems.append(f"rows: {len(a)} and {len(b)}")
    elif set(a.columns) == set(b.columns):
        cols = sorted(a.columns)
        ha = sorted(zip(*[a[c].map(_cell) for c in cols]))
        hb = sorted(zip(*[b[c].map(_cell) for c in cols]))
        bad = [(x, y) for x, y in zip(ha, hb) if x != y]
        if bad:
            problems.append(f"{len(bad)} of {len(ha)} rows, as {bad[:2]}")
    return len(a), problems


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v) + 0.0:.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)
