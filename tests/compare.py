"""Row-set comparison of a Spark result with an oracle result."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x)
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    return x


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_value(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql) -> list[str]:
    got_columns, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    only_got, only_want = got - want, want - got
    if not only_got and not only_want:
        return []
    return [f"rows {got.total()} vs {want.total()}", f"only spark {list(only_got.items())[:3]}", f"only oracle {list(only_want.items())[:3]}"]
