"""Runs a registered query in Spark and its SQL in DuckDB, and compares names, types and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE"}


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def spark_rows(df):
    names = sorted(df.columns)
    rows = sorted((tuple(_value(r[n]) for n in names) for r in df.collect()), key=repr)
    types = dict(df.dtypes)
    return names, [types[n] for n in names], rows


def sql_rows(con, sql: str):
    result = con.execute(sql)
    columns = [(d[0], str(d[1])) for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i][0])
    rows = sorted((tuple(_value(r[i]) for i in order) for r in result.fetchall()), key=repr)
    return [columns[i][0] for i in order], [columns[i][1] for i in order], rows


def differences(df, con, sql: str) -> list[str]:
    names, types, rows = spark_rows(df)
    sql_names, sql_types, expected = sql_rows(con, sql)
    found = []
    if names != sql_names:
        return [f"columns {names} but SQL gives {sql_names}"]
    for name, kind, sql_kind in zip(names, types, sql_types):
        if TYPES.get(kind, kind) != sql_kind:
            found.append(f"type of {name} is {kind} but SQL gives {sql_kind}")
    if len(rows) != len(expected):
        found.append(f"{len(rows)} rows but SQL gives {len(expected)}")
    only = [r for r in rows if r not in set(expected)][:3] if rows != expected else []
    other = [r for r in expected if r not in set(rows)][:3] if rows != expected else []
    if only or other:
        found.append(f"only Spark: {only}; only SQL: {other}")
    elif rows != expected:
        found.append("rows differ in number of copies")
    return found
