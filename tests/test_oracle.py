"""Every query with reference SQL gives the same table as DuckDB."""

import pytest
from compare import differences, duck, duck_table, spark_table

from loanloom.queries.registry import QUERIES
from oracle.registry import ORACLE


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_names_match():
    assert set(ORACLE) <= set(QUERIES)
    trained = {"boosted_scores", "boosted_explanations", "scored_requests", "linear_explanations"}
    assert set(QUERIES) - set(ORACLE) == trained


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, con, name):
    result = spark_table(QUERIES[name](spark, sf))
    expected = duck_table(con, ORACLE[name])
    assert differences(result, expected) == []
