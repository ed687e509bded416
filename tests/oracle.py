"""Comparison of a Spark result with DuckDB over the same files."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, decimal.Decimal):
        raise AssertionError("results carry no decimals")
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def kind(type_name: str) -> str:
    name = type_name.lower()
    for family, members in {
        "int": ("bigint", "integer", "int"),
        "float": ("double", "float"),
        "text": ("varchar", "string"),
        "bool": ("boolean",),
        "time": ("timestamp", "timestamp_ntz"),
        "date": ("date",),
    }.items():
        if name in members:
            return name if family == "int" and name == "bigint" else {"int": "int", "integer": "int"}.get(name, family)
    return name


def compare(df, con, sql: str) -> int:
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    types = {d[0]: kind(str(d[1])) for d in expected.description}
    want = expected.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema} == types
    got = df.collect()
    assert len(got) == len(want)
    assert rows_of(df.columns, got) == rows_of(names, want)
    return len(want)
