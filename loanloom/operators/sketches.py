"""Distinct counts that can be added up: mergeable sketches, kept per key and batch.

An exact distinct count has to see all rows again for every new day. A sketch of each batch
(such as a day) is a value of bounded size that can be stored; the sketches of any set of
batches merge to the count over all of them, values they share counted once. Small
counts (a few hundred at the default size) are exact but for collisions of 26-bit hashes;
above, the relative standard error is about 0.83 / sqrt(2 ** SIZE), that is 1.3 %, and some
more after merging. The exact count stays the default of the feature blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.operators.grouped import with_keys
from loanloom.schemas import CUSTOMER, LOAN

# Base-2 logarithm of the slots; a full sketch has a byte for each of them and a short header.
SIZE = 12
SKETCH = "sketch"


def distinct_sketches(
    df: DataFrame, column: str, keys: Sequence[str] = (CUSTOMER,), batch: str | None = None,
    size: int = SIZE,
) -> DataFrame:
    """(keys, batch, sketch) of the distinct non-null values of a column.

    Rows merge into sketches before the shuffle, so a frequent key is one sketch per task. A
    NULL key or batch forms no group; a group without values has a sketch of nothing.
    Without keys and batch there is one row, as in any global aggregate.
    """
    names = [*keys, *([batch] if batch else [])]
    value = F.col(column)
    if df.schema[column].dataType.typeName() not in ("integer", "long", "string", "binary"):
        value = value.cast("string")
    rows = with_keys(df, names) if names else df
    return rows.groupBy(*names).agg(F.hll_sketch_agg(value, F.lit(size)).alias(SKETCH))


def merged(sketches: DataFrame, keys: Sequence[str] = (CUSTOMER,)) -> DataFrame:
    """(keys, sketch): one sketch over all batches of a key, of whatever sizes."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg(SKETCH, F.lit(True)).alias(SKETCH))


def distinct_counts(
    sketches: DataFrame, keys: Sequence[str] = (CUSTOMER,), name: str = "distinct_count"
) -> DataFrame:
    """(keys, name): the distinct values over all batches that are in ``sketches``."""
    total = F.hll_sketch_estimate(SKETCH).alias(name)
    return merged(sketches, keys).select(*keys, total)


def pos_loans(cash_pos: DataFrame, batch: str, keys: Sequence[str] = (CUSTOMER,)) -> DataFrame:
    """Sketches of the point-of-sale loans, for NUM_POS_LOANS kept up day by day."""
    return distinct_sketches(cash_pos, LOAN, keys, batch)


def store_sketches(sketches: DataFrame, path: str, batch: str) -> None:
    """Add batches to a stored table of sketches.

    A batch that is stored already is replaced, so a batch that ran twice or was cut short
    counts once; the other batches are not read or written.
    """
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(batch).parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The stored sketches; filters on the batch read only its folders."""
    return spark.read.parquet(path)
