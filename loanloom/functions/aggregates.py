"""Aggregate expressions with the null rules of the feature tables, as Spark SQL text.

Sums of nothing are 0, means and extremes of nothing are NULL, comparisons with
NULL count as false. A whole block of them fits in one ``groupBy().agg()`` with
fixed-width buffers: it stays a code-generated hash aggregate, combines map-side
and can spill. Text keeps building a block of a hundred columns cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.schemas import is_fractional, is_number

ROWS = "count(1)"


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ratio(numerator: str, denominator: str) -> str:
    """a / b as DOUBLE; NULL when b is 0 or either side is NULL."""
    return f"try_divide(CAST({numerator} AS DOUBLE), CAST({denominator} AS DOUBLE))"


def safe_ratio(numerator: str, denominator: str) -> str:
    """a / b with every undefined result turned into 0."""
    return f"coalesce({ratio(numerator, denominator)}, 0D)"


def mean(x: str) -> str:
    """Mean from sum and count, so it shares their buffers with other aggregates."""
    return ratio(f"sum({x})", f"count({x})")


def total(x: str) -> str:
    return f"coalesce(CAST(sum({x}) AS DOUBLE), 0D)"


def int_total(x: str) -> str:
    return f"coalesce(sum({x}), 0L)"


def highest(x: str) -> str:
    return f"CAST(max({x}) AS DOUBLE)"


def lowest(x: str) -> str:
    return f"CAST(min({x}) AS DOUBLE)"


def deviation(x: str) -> str:
    """Sample standard deviation; a single value has none, which counts as 0."""
    return f"coalesce(stddev_samp(CAST({x} AS DOUBLE)), 0D)"


def share(condition: str) -> str:
    """Share of all rows in the group, rows with NULL included."""
    return f"count_if({condition}) / {ROWS}"


def any_flag(condition: str) -> str:
    return f"CAST(coalesce(bool_or({condition}), false) AS INT)"


def years(days: str) -> str:
    return f"abs({days}) / 365D"


def measure(sql: str, name: str) -> Column:
    return F.expr(sql).alias(name)


def prefixed(prefix: str, measures: dict[str, str]) -> dict[str, str]:
    return {f"{prefix}_{name}": sql for name, sql in measures.items()}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if is_number(f.dataType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [
        f.name
        for f in df.schema
        if f.dataType.typeName() == "string" and f.name not in exclude
    ]


def numeric_stats(df: DataFrame, names: list[str], prefix: str) -> dict[str, str]:
    """mean, sum, max and min of each column, named ``{prefix}_agg_{column}_{stat}``."""
    schema, out = df.schema, {}
    for name in names:
        x, stem = f"`{name}`", f"{prefix}_agg_{name}"
        out[f"{stem}_mean"] = mean(x)
        if is_fractional(schema[name].dataType):
            out |= {f"{stem}_sum": total(x), f"{stem}_max": highest(x), f"{stem}_min": lowest(x)}
        else:
            out |= {
                f"{stem}_sum": int_total(x),
                f"{stem}_max": f"max({x})",
                f"{stem}_min": f"min({x})",
            }
    return out
