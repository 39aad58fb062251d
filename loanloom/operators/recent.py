"""Means over the most recent rows of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.aggregates import mean, measure
from loanloom.operators.grouped import with_keys


def recent_means(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, tuple[str, int]],
) -> DataFrame:
    """``measures`` maps result names to (column, n): the mean of the last n rows.

    Rows count whether or not the value is NULL. The row-number filter lets Spark
    cut every key to n rows per task before the shuffle, so the largest key costs
    n rows per map task. Values break ties, which makes the result repeatable.
    """
    names = list(dict.fromkeys(column for column, _ in measures.values()))
    depth = max(n for _, n in measures.values())
    latest = [F.col(c).desc_nulls_last() for c in [*order, *names]]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*latest))
    top = (
        with_keys(df, keys)
        .select(*keys, *order, *[n for n in names if n not in order])
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= depth)
    )

    def recent_mean(column: str, n: int) -> str:
        return mean(f"CASE WHEN __rank <= {n} THEN `{column}` END")

    return top.groupBy(*keys).agg(
        *[measure(recent_mean(column, n), alias) for alias, (column, n) in measures.items()]
    )
