"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.session import configure
from loanloom.sources.adapters import lending_tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return lending_tables(spark, sf_dir, exact=True, names=[name])[name]


def tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    configure(spark)
    return lending_tables(spark, sf_dir, exact=True, names=names)


def single(df: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """Columns whose name contains a marker, in single precision."""
    return df.select(
        *[
            F.col(n).cast("float").cast("double").alias(n) if any(m in n for m in markers) else n
            for n in df.columns
        ]
    )


def as_double(df: DataFrame) -> DataFrame:
    """DECIMAL columns as DOUBLE."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if f.dataType.typeName() == "decimal"
            else F.col(f.name)
            for f in df.schema
        ]
    )


# The last digits of these depend on the order of additions: deviations, and means
# and sums of record-level means and shares.
LOOSE = ("_STD_",)
LOOSE_TIMELINE = tuple(
    f"credit_timeline_{name}_{stat}"
    for name in ("agg_TIME_SINCE_ENTRY_mean", "PERCENT_CLOSED", "PERCENT_ACTIVE")
    for stat in ("mean", "sum")
)
