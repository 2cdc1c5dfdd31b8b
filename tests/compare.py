"""Compare a Spark result with its DuckDB oracle, regardless of row order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from driftline.sources.views import TABLES


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return plain(float(value))
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


# the Spark types that a DuckDB type may meet
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz"}


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(v) for v in row] for row in df.select(*names).collect()), key=repr)


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    kinds = {c[0]: str(c[1]) for c in found.description}
    order = [names.index(n) for n in sorted(names)]
    rows = sorted(([plain(row[i]) for i in order] for row in found.fetchall()), key=repr)
    return sorted(names), rows, kinds


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    names, ours = spark_rows(df)
    their_names, theirs, kinds = duck_rows(con, sql)
    if names != their_names:
        return f"columns {names} against {their_names}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    if bad := [(n, types[n], kinds[n]) for n in names if TYPES.get(kinds[n], kinds[n]) != types[n]]:
        return f"types {bad}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}; first {ours[:2]} {theirs[:2]}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"row {a} against {b}"
    return None
