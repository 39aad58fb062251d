"""Mergeable distinct counts and stored numbers of fitted scorers."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loanloom.operators import sketches
from loanloom.plans import scoring, stored
from loanloom.plans.training import LinearModel
from loanloom.queries.common import as_double, table

SCHEMA = "CUSTOMER_ID long, PRIOR_LOAN_ID long, day int"


@pytest.fixture(scope="module")
def large(spark):
    """Five days of 60,000 loans of one hot customer, half of them seen the day before, and a small one."""
    hot = spark.range(300_000).selectExpr(
        "1L AS CUSTOMER_ID", "id % 60000 + 30000 * (id DIV 60000) AS PRIOR_LOAN_ID",
        "CAST(id DIV 60000 AS INT) AS day",
    )
    small = spark.range(500).selectExpr("2L", "id % 40", "CAST(id % 5 AS INT)")
    return hot.union(small)


def test_days_add_up_within_the_bound(large):
    daily = sketches.pos_loans(large, "day")
    assert daily.count() == 10
    got = dict(rows(sketches.distinct_counts(daily, name="n"), "CUSTOMER_ID"))
    assert got[2] == 40
    assert got[1] == pytest.approx(180_000, rel=0.06)
    part = dict(rows(sketches.distinct_counts(daily.filter("day < 2")), "CUSTOMER_ID"))
    assert part[1] == pytest.approx(90_000, rel=0.06) and part[2] == 16


def test_sketch_does_not_grow_with_the_group(large):
    sizes = sketches.distinct_sketches(large, "PRIOR_LOAN_ID").select(F.max(F.octet_length("sketch")))
    assert sizes.first()[0] <= 2**sketches.SIZE + 64


def test_stored_days_are_replaced_not_added(spark, large, tmp_path):
    path = str(tmp_path / "sketches")
    for days in ("day < 3", "day = 2", "day >= 3"):
        sketches.store_sketches(sketches.pos_loans(large.filter(days), "day"), path, "day")
    back = sketches.read_sketches(spark, path)
    assert back.count() == 10
    whole = sketches.distinct_counts(sketches.pos_loans(large, "day"))
    again = sketches.distinct_counts(back.select("CUSTOMER_ID", "day", "sketch"))
    assert dict(rows(again))[2] == 40
    assert dict(rows(again))[1] == pytest.approx(dict(rows(whole))[1], rel=0.03)


def test_nulls_empty_tables_and_sizes(spark):
    df = spark.createDataFrame(
        [(1, 5, 1), (1, 5, 2), (1, None, 1), (None, 7, 1), (2, None, 1), (3, 8, None)], SCHEMA
    )
    daily = sketches.pos_loans(df, "day")
    assert rows(sketches.distinct_counts(daily), "CUSTOMER_ID") == [(1, 1), (2, 0)]
    coarse = sketches.distinct_sketches(df.filter("day = 1"), "PRIOR_LOAN_ID", size=8)
    both = daily.select("CUSTOMER_ID", "sketch").union(coarse)
    assert rows(sketches.distinct_counts(both), "CUSTOMER_ID") == [(1, 1), (2, 0)]
    total = sketches.distinct_sketches(df, "PRIOR_LOAN_ID", keys=())
    assert rows(sketches.distinct_counts(total, keys=())) == [(3,)]
    empty = df.filter("false")
    assert rows(sketches.distinct_counts(sketches.pos_loans(empty, "day"))) == []
    texts = df.selectExpr("CUSTOMER_ID", "CAST(PRIOR_LOAN_ID AS DOUBLE) AS x")
    assert dict(rows(sketches.distinct_counts(sketches.distinct_sketches(texts, "x"))))[1] == 1


def test_rule_round_trip(spark, sf, tmp_path):
    profile = as_double(table(spark, sf, "customer_profile"))
    fitted = stored.fit_rule(profile)
    stored.write_rule(spark, fitted, str(tmp_path / "rule"))
    again = stored.read_numbers(spark, str(tmp_path / "rule"), ("median", "mean"))
    assert again == fitted and list(again["mean"]) == list(fitted["mean"])
    names = ("CUSTOMER_ID", "default_probability", "explanations")
    first = scoring.rule_scorer(fitted["median"], fitted["mean"])(profile).select(*names)
    second = stored.read_rule(spark, str(tmp_path / "rule"))(profile).select(*names)
    assert rows(first, "CUSTOMER_ID") == rows(second, "CUSTOMER_ID")


def test_linear_round_trip(spark, tmp_path):
    model = LinearModel({"b": 0.1 + 0.2, "a": -1e-300}, {"b": None, "a": 3.0}, float("inf"))
    stored.write_linear(spark, model, str(tmp_path / "linear"))
    assert stored.read_linear(spark, str(tmp_path / "linear")) == model
    with pytest.raises(ValueError, match="median"):
        stored.read_rule(spark, str(tmp_path / "linear"))
