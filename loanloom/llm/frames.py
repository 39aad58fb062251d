"""Small helpers for frames: internal names, shared tables, document identity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.sources.shared import written  # noqa: F401


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, version, body): a document is what shares an id and a text.

    Rows that repeat both are one document; rows that share only the id differ in
    `version`, a hash of the text. Null texts are empty.
    """
    body = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("id"), F.xxhash64(body).alias("version"), body.alias("body")
    )


def same(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on the document; null ids match each other."""
    return left["id"].eqNullSafe(right["id"]) & (left["version"] == right["version"])


def with_text(docs: DataFrame, text_col: str, decisions: DataFrame, value: str, id_col: str,
              change: Callable[[pa.Array, pa.Array], pa.Array]) -> DataFrame:
    """All columns of docs with the text changed by the decision about its document.

    decisions holds (id, version, value), at most one row for each document;
    change(texts, values) gives the new texts. A null text without decision stays null.
    """
    key, ident = fresh(docs, "version"), id_col
    extra = fresh(docs, value)
    own = docs.withColumn(key, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    right = decisions.select(
        F.col("id").alias("decided_id"), F.col("version").alias("decided"), F.col(value).alias("v")
    )
    on = own[ident].eqNullSafe(right["decided_id"]) & (own[key] == right["decided"])
    joined = own.join(right, on, "left").select(
        *[own[c] for c in docs.columns], right["v"].alias(extra)
    )
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = change(columns[at], batch.column(batch.num_columns - 1))
            yield pa.record_batch(columns, batch.schema.names[:-1])

    return joined.mapInArrow(rows, T.StructType(docs.schema.fields))
