"""Run a registered query and its DuckDB twin on the same files; compare rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain_rows = [tuple(plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain_rows, key=repr)


def spark_table(df):
    return table_of(df.columns, [tuple(row) for row in df.collect()])


def duckdb_table(con, sql):
    cursor = con.execute(sql)
    columns = [item[0] for item in cursor.description]
    return table_of(columns, cursor.fetchall())
