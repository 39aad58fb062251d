"""Readers and writers of tables, metadata and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.functions.cleaning import nan_to_null
from loanloom.operators.alignment import FeatureSchema
from loanloom.schemas import CUSTOMER, TABLE_COLUMNS, table_schema
from loanloom.sources.shared import shuffles_dropped


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """A raw table with its declared schema (nothing is inferred), NaN as NULL."""
    reader = spark.read.schema(table_schema(table)).format(fmt)
    return nan_to_null(reader.load(path))


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {t: read_table(spark, f"{root}/{t}", t, fmt) for t in TABLE_COLUMNS}


def write_bucketed(
    df: DataFrame,
    name: str,
    buckets: int,
    key: str = CUSTOMER,
    path: str | None = None,
    placed: bool = False,
) -> DataFrame:
    """Store a table bucketed by its key and read it back.

    Aggregates and joins on the key then need no shuffle. The rows are shuffled here
    once, one file to a bucket, unless they are ``placed`` already. A bucket is one task
    of every later query, so this is for keys of which none holds a large part of the rows.
    """
    rows = df if placed else df.repartition(buckets, key)
    writer = rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    with shuffles_dropped(df.sparkSession):
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_column_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").json(path)


def read_column_profile(spark: SparkSession, path: str) -> DataFrame:
    schema = (
        "`table` string, `column` string, dtype string, min double, max double, "
        "mean double, std double, categories array<string>"
    )
    return spark.read.schema(schema).json(path)


def category_columns(profile: DataFrame, table: str) -> list[str]:
    """Names of the columns the profile declares as categories."""
    rows = profile.filter((F.col("table") == table) & (F.col("dtype") == "category"))
    return [r["column"] for r in rows.select("column").distinct().collect()]


def force_categories(df: DataFrame, names: list[str]) -> DataFrame:
    """Declared category columns as text, whatever type they arrived with."""
    present = [n for n in names if n in df.columns]
    return df.withColumns({n: F.col(n).cast("string") for n in present}) if present else df


_FEATURE_SCHEMA = "pos int, feature string, dtype string, categories array<string>"


def write_feature_schema(spark: SparkSession, schema: FeatureSchema, path: str) -> None:
    rows = [
        (i, name, schema.dtypes[name], schema.categories.get(name))
        for i, name in enumerate(schema.features)
    ]
    spark.createDataFrame(rows, _FEATURE_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_feature_schema(spark: SparkSession, path: str) -> FeatureSchema:
    rows = spark.read.schema(_FEATURE_SCHEMA).json(path).orderBy("pos").collect()
    return FeatureSchema(
        [r["feature"] for r in rows],
        {r["feature"]: r["dtype"] for r in rows},
        {r["feature"]: r["categories"] for r in rows if r["categories"] is not None},
    )


def read_feature_document(spark: SparkSession, path: str) -> FeatureSchema:
    """A feature schema kept as one JSON object {features, dtypes, category_mappings}."""
    shape = (
        "features array<string>, dtypes map<string,string>, "
        "category_mappings map<string,array<string>>"
    )
    row = spark.read.schema(shape).option("multiLine", True).json(path).first()
    return FeatureSchema(
        list(row["features"]), dict(row["dtypes"]), dict(row["category_mappings"] or {})
    )


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
