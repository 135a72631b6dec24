"""Compares a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def in_order(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, function, sql: str) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    result = function(spark, sf_dir)
    mine = in_order([tuple(r) for r in result.collect()], result.columns)
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = in_order(cursor.fetchall(), names)
    assert sorted(result.columns) == sorted(names)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for left, right in zip(mine, theirs):
        assert left == right, (sorted(names), left, right)
    return len(mine)
