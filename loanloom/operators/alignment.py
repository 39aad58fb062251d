"""Bring feature rows to the schema a model was trained on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.cleaning import number, to_bigint
from loanloom.operators.skew import join_unique
from loanloom.schemas import MISSING, is_number
from loanloom.sources.shared import written

_CODE = "__code"


@dataclass
class FeatureSchema:
    """Feature names in training order, their types and label domains."""

    features: list[str]
    dtypes: dict[str, str]  # 'int64', 'Int64', 'float64' or 'category'
    categories: dict[str, list[str]] = field(default_factory=dict)


DTYPE_NAMES = {"bigint": "int64", "int": "int64", "double": "float64", "string": "category"}


def schema_of(df: DataFrame, exclude=(), domains_as_lists: bool = True) -> FeatureSchema:
    """Feature schema of a training table; label domains come from its values.

    Vocabularies too large for the driver stay in a table of ``label_codes`` instead of lists.
    """
    fields = [f for f in df.schema if f.name not in exclude]
    dtypes = {f.name: DTYPE_NAMES.get(f.dataType.simpleString(), "float64") for f in fields}
    texts = [n for n, t in dtypes.items() if t == "category"]
    domains = {}
    if texts and domains_as_lists:
        domains = {r["feature"]: r["categories"] for r in category_domains(df, texts).collect()}
    return FeatureSchema([f.name for f in fields], dtypes, domains)


def category_domains(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, categories): the sorted distinct labels of each category column.

    Labels are made distinct per feature before they are gathered, so only the
    vocabulary of a column, never its rows, forms an array.
    """
    long = df.select(*names).unpivot([], names, "feature", "category")
    distinct = long.filter(F.col("category").isNotNull()).distinct()
    return distinct.groupBy("feature").agg(
        F.array_sort(F.collect_list("category")).alias("categories")
    )


def label_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, label, code): the labels of each column, numbered from 0 in order, as a stored table.

    Distinct labels are range-partitioned and keep their place in the partition; a feature's places
    go on from one partition to the next by one count for each of both. No array, window
    or task ever holds a column's labels, so a vocabulary may have any size.
    """
    long = df.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot([], names, "feature", "label")
    distinct = long.filter(F.col("label").isNotNull()).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartitionByRange(parts, "feature", "label").sortWithinPartitions("feature", "label")
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "labels")
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("feature", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    # A row for each feature and partition.
    before = F.sum("n").over(Window.partitionBy("feature").orderBy("part")) - F.col("n")
    offsets = counts.withColumn("before", before).select("feature", "part", "first", "before")
    code = F.col("before") + F.col("place") - F.col("first")
    return placed.join(offsets, ["feature", "part"]).select("feature", "label", code.alias("code"))


def with_codes(df: DataFrame, names: list[str], codes: DataFrame, suffix: str) -> DataFrame:
    """Add the code of every named column's label; NULL for a label that the table lacks.

    A join for each column: adaptive execution broadcasts the part of the table that is small enough
    and otherwise shuffles both sides for that join, so that a frequent label may be split.
    """
    for name in names:
        found = codes.filter(F.col("feature") == name).select(
            F.col("label").alias("__label"), F.col("code").alias(name + suffix)
        )
        own = df.withColumn("__label", F.col(name).cast("string"))
        df = join_unique(own, found, ["__label"], "left").drop("__label")
    return df


def align(df: DataFrame, features: list[str]) -> DataFrame:
    """Exactly the given columns in order: absent ones are 0, others are dropped."""
    return df.select(
        *[F.col(n) if n in df.columns else F.lit(0).alias(n) for n in features]
    )


def _in_domain(df: DataFrame, name: str, domain: list[str]) -> Column:
    text = F.col(name).cast("string")
    return F.when(text.isin(domain), text)


def enforce_types(df: DataFrame, schema: FeatureSchema, codes: DataFrame | None = None) -> DataFrame:
    """Cast every feature to its training type; labels outside the domain become NULL.

    Domains are those of ``codes``, a table of ``label_codes``, for the features that it is
    given for; without a table they are the lists in the schema.
    """
    columns = {}
    for name in [n for n in schema.features if n in df.columns]:
        kind = schema.dtypes[name]
        domain = schema.categories.get(name)
        if kind in ("int64", "Int64"):
            columns[name] = to_bigint(df, name)
        elif kind == "float64":
            columns[name] = number(df, name)
        elif domain is None or codes is not None:
            columns[name] = F.col(name).cast("string")
        else:
            columns[name] = _in_domain(df, name, domain)
    typed = df.withColumns(columns)
    if codes is None:
        return typed
    texts = [n for n in columns if schema.dtypes[n] == "category"]
    coded = with_codes(typed, texts, codes, _CODE)
    return coded.select(
        *[F.when(F.col(c + _CODE).isNotNull(), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def fill_scoring(df: DataFrame, fill: str = "null") -> DataFrame:
    """Labels become 'Missing'; numbers stay NULL, or become 0 with ``fill='zero'``."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    out = df.fillna(MISSING, subset=texts) if texts else df
    return out.fillna(0) if fill == "zero" else out


def fill_training(df: DataFrame) -> DataFrame:
    """Numbers become 0, labels 'Missing'."""
    numbers = [f.name for f in df.schema if is_number(f.dataType)]
    filled = {n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType)) for n in numbers}
    return fill_scoring(df.withColumns(filled) if filled else df)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns without any value. One pass; only the counts reach the driver."""
    counts = df.agg(*[F.count(n).alias(n) for n in df.columns]).first()
    return df.select(*[n for n in df.columns if counts[n] > 0])


def union_batches(frames: list[DataFrame]) -> DataFrame:
    """Stack feature tables whose columns may differ; absent ones are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
