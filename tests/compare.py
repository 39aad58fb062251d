"""Compare Spark queries with their DuckDB reference SQL, value by value."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duck_table(con, sql):
    cursor = con.execute(sql)
    return table([d[0] for d in cursor.description], cursor.fetchall())


def differences(left, right, limit: int = 5) -> list[str]:
    """Messages about every difference between two (columns, rows) tables."""
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return [f"columns: only left {set(lc) - set(rc)}, only right {set(rc) - set(lc)}"]
    if len(lr) != len(rr):
        return [f"rows: {len(lr)} against {len(rr)}"]
    out = []
    for a, b in zip(lr, rr):
        if a != b:
            out.append(str([(c, x, y) for c, x, y in zip(lc, a, b) if x != y][:4]))
            if len(out) >= limit:
                break
    return out
