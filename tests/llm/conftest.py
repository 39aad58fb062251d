import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The 200 documents of the smallest table as (id, text, lang, source)."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (id, text) pairs, over several partitions."""

    def make(pairs, parts=3):
        rows = [(k, t, "en", "src0", len(t or "")) for k, t in pairs]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return make
