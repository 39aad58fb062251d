"""Generic aggregates of any table: numeric statistics and most frequent labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanloom.functions.aggregates import numeric_columns, numeric_stats, text_columns
from loanloom.operators.grouped import grouped
from loanloom.schemas import CUSTOMER, LOAN, RECORD, REQUEST

IDENTIFIERS = (CUSTOMER, LOAN, RECORD, REQUEST)


def stats_of(df: DataFrame, keys: list[str], prefix: str):
    return numeric_stats(df, numeric_columns(df, exclude=(*IDENTIFIERS, *keys)), prefix)


def modes_of(df: DataFrame, keys: list[str], prefix: str) -> dict[str, str]:
    names = text_columns(df, exclude=(*IDENTIFIERS, *keys))
    return {f"{prefix}_agg_{name}_most_frequent": name for name in names}


def numeric_aggregates(df: DataFrame, prefix: str, keys=(CUSTOMER,)) -> DataFrame:
    """mean, sum, max and min of every numeric column per key."""
    keys = list(keys)
    return grouped(df, keys, stats_of(df, keys, prefix))


def categorical_modes(
    df: DataFrame, prefix: str, keys=(CUSTOMER,), closed_labels: bool = False
) -> DataFrame:
    """Most frequent value of every text column per key, 'Unknown' if it has none."""
    keys = list(keys)
    return grouped(df, keys, {}, modes_of(df, keys, prefix), closed_labels=closed_labels)
