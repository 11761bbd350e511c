"""Rows of a registered query and of its DuckDB SQL, in one comparable form."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([normal(x) for x in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return None if value is None else str(value)


def connection(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


def same(spark, con, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, got.fetchall())
