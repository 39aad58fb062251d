"""Pieces the oracle queries are assembled from."""

from __future__ import annotations

import re

from loanloom.sources.adapters import DUCKDB_DAYS, MONEY_EXACT, VIEWS, dialect

KEY = "CUSTOMER_ID"


def view(name: str) -> str:
    return dialect(VIEWS[name], DUCKDB_DAYS, MONEY_EXACT)


def duck(sql: str) -> str:
    return dialect(sql, DUCKDB_DAYS, MONEY_EXACT)


def with_views(query: str) -> str:
    """Prefix the adapter views that a query names as v_<table>."""
    used = [n for n in VIEWS if re.search(rf"\bv_{n}\b", query)]
    ctes = ",\n".join(f"v_{n} AS ({view(n)}\n)" for n in used)
    return f"WITH {ctes}\n{query}" if used else query


def mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / nullif(count({x}), 0)"


def total(x: str) -> str:
    return f"coalesce(CAST(sum({x}) AS DOUBLE), 0e0)"


def int_total(x: str) -> str:
    return f"coalesce(CAST(sum({x}) AS BIGINT), 0)"


def ratio0(a: str, b: str) -> str:
    return f"coalesce({a} / nullif({b}, 0), 0e0)"


def count_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def share(condition: str) -> str:
    return f"CAST({count_if(condition)} AS DOUBLE) / count(*)"


def flag(condition: str) -> str:
    return f"CAST(coalesce(bool_or({condition}), false) AS INTEGER)"


def std(x: str) -> str:
    return single(f"coalesce(stddev_samp(CAST({x} AS DOUBLE)), 0)")


def single(x: str) -> str:
    return f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"


def stats(prefix: str, ints: list[str], money: list[str]) -> list[str]:
    out = []
    for x in ints:
        s = f"{prefix}_agg_{x}"
        out += [
            f"{mean(x)} AS {s}_mean",
            f"{int_total(x)} AS {s}_sum",
            f"max({x}) AS {s}_max",
            f"min({x}) AS {s}_min",
        ]
    for x in money:
        s = f"{prefix}_agg_{x}"
        out += [
            f"{mean(x)} AS {s}_mean",
            f"{total(x)} AS {s}_sum",
            f"CAST(max({x}) AS DOUBLE) AS {s}_max",
            f"CAST(min({x}) AS DOUBLE) AS {s}_min",
        ]
    return out


def keyed(key: str) -> str:
    return " AND ".join(f"{k.strip()} IS NOT NULL" for k in key.split(","))


def mode_of(source: str, key: str, column: str) -> str:
    return (
        f"SELECT {key}, {column} AS v FROM (SELECT {key}, {column}, row_number() OVER "
        f"(PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS rn FROM {source} "
        f"WHERE {column} IS NOT NULL AND {keyed(key)} GROUP BY {key}, {column}) WHERE rn = 1"
    )


def block(source: str, key: str, measures: list[str], modes: dict[str, str]) -> str:
    """SELECT of one row per key: measures plus most frequent values."""
    inner = ", ".join([key, *measures])
    sql = f"SELECT {inner} FROM {source} WHERE {keyed(key)} GROUP BY {key}"
    if not modes:
        return sql
    columns, joins = ["b.*"], []
    for i, (alias, column) in enumerate(modes.items()):
        columns.append(f"coalesce(m{i}.v, 'Unknown') AS {alias}")
        joins.append(f"LEFT JOIN ({mode_of(source, key, column)}) m{i} USING ({key})")
    return f"SELECT {', '.join(columns)} FROM ({sql}) b {' '.join(joins)}"


def named(prefix: str, pairs: dict[str, str]) -> list[str]:
    return [f"{sql} AS {prefix}_{name}" for name, sql in pairs.items()]
