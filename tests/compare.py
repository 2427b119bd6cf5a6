"""Runs a query and its SQL on the same files and compares the rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def difference(df, con, statement: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    expected = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in result.description}
    wrong = {name: (kind, kinds[name]) for name, kind in df.dtypes if TYPES.get(kind) != kinds[name]}
    actual = rows_of(df.columns, df.collect())
    if actual != expected:
        extra = [row for row in actual if row not in set(expected)][:3]
        missing = [row for row in expected if row not in set(actual)][:3]
        return f"{len(actual)} rows != {len(expected)} rows ({sorted(columns)}); only Spark: {extra}; only SQL: {missing}"
    return f"types {wrong}" if wrong else None
