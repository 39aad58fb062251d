"""Exact and weighted quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import quantiles
from loanloom.operators.blocks import credit_timeline

PROBABILITIES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    df = df.withColumn("column", F.lit("x"))
    got = quantiles.exact_quantiles(df, "column", "value", PROBABILITIES)
    result = {r.probability: r.value for r in got.collect()}
    expected = dict(zip(PROBABILITIES, np.quantile(values, PROBABILITIES)))
    assert result == pytest.approx(expected, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 101])
def test_small(spark, n):
    check(spark, np.random.default_rng(n).normal(size=n))


@pytest.mark.parametrize("seed", [1, 2])
def test_wide_range(spark, seed):
    rng = np.random.default_rng(seed)
    check(spark, rng.lognormal(sigma=3, size=60_001))


def test_one_value_holds_a_third(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(20_000, 7.0), rng.normal(7, 1, size=40_000)])
    check(spark, values)


def test_two_values(spark):
    check(spark, np.array([1.0] * 30_000 + [2.0] * 30_000))


def test_medians_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (10, 6.0)], "a long, b double")
    assert quantiles.medians(df, ["a", "b"]).first().asDict() == {"a": 2.0, "b": 5.5}


EXTREMES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-310, -1e-310, 1.0, 2.0,
            4.0, -4.0, np.nextafter(4.0, 0), np.nextafter(4.0, 9), 0.5, np.nextafter(0.5, 0), 1e308, -1e308,
            1.7976931348623157e308, 2.0**1023, np.nextafter(2.0**1023, 0), float("inf"), float("-inf")]


def test_bits_order_like_values(spark):
    rng = np.random.default_rng(4)
    more = np.concatenate([rng.normal(size=300), rng.lognormal(sigma=200, size=300), 2.0 ** np.arange(-1074, 1024)])
    values = [*map(float, EXTREMES), *map(float, more), *map(float, np.nextafter(more, 0))]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["bits"] for r in quantiles.ordered_bits(df, "v", "bits").collect()}
    for v, bits in got.items():
        size = int(np.array([abs(v)]).view(np.int64)[0])
        assert bits == (-size if v < 0 else size), v
    last = quantiles.ordered_bits(df.selectExpr("double('nan') AS v").limit(1), "v", "bits").first()["bits"]
    assert last > max(got.values())


def test_extreme_values_come_back(spark):
    values = sorted(float(v) for v in EXTREMES if abs(v) < 1e300)
    df = spark.createDataFrame([("x", v) for v in values], "column string, value double")
    points = [i / (len(values) - 1) for i in range(len(values))]
    got = [r["value"] for r in quantiles.exact_quantiles(df, "column", "value", points).orderBy("probability").collect()]
    assert got == pytest.approx(values, rel=1e-9, abs=0)


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_repeat_rows(spark, seed):
    rng = np.random.default_rng(seed)
    values, times = rng.normal(size=200).round(1), rng.integers(0, 5, size=200)
    rows = [("x", float(v), int(t)) for v, t in zip(values, times)] + [("x", None, 3), ("x", 9e9, None)]
    df = spark.createDataFrame(rows, "column string, value double, times int")
    got = quantiles.describe(df, "column", "value", weight="times").first()
    repeated = spark.createDataFrame([("x", float(v)) for v in np.repeat(values, times)], "column string, value double")
    want = quantiles.describe(repeated, "column", "value").first()
    for name in want.asDict():
        assert got[name] == (pytest.approx(want[name], rel=1e-9, abs=1e-12) if name != "column" else "x"), name


def test_weight_of_one_row(spark):
    rows = [("x", 4.0, 10**12), ("x", 5.0, 1), ("y", 7.0, 1), ("z", None, 4)]
    df = spark.createDataFrame(rows, "column string, value double, times long")
    got = {r["column"]: r.asDict() for r in quantiles.describe(df, "column", "value", weight="times").collect()}
    assert (got["x"]["count"], got["x"]["q75"], got["x"]["max"]) == (10**12 + 1, 4.0, 5.0)
    assert (got["y"]["count"], got["y"]["std"], got["y"]["q25"]) == (1, None, 7.0)
    assert (got["z"]["count"], got["z"]["mean"], got["z"]["q50"]) == (0, None, None)


def test_placeholder_record_of_very_many_customers(spark):
    """One record belongs to ten million customers; the others to one or to none."""
    age = f"{credit_timeline.PREFIX}_agg_{credit_timeline.MONTH}_mean"
    records = spark.range(100).selectExpr("id AS CREDIT_RECORD_ID", f"CAST(id AS DOUBLE) AS {age}")
    many = spark.range(10_000_000).selectExpr("0L AS CREDIT_RECORD_ID", "id AS CUSTOMER_ID")
    mapping = many.union(spark.range(1, 50).selectExpr("id", "id"))
    got = {r["records"]: r.asDict() for r in credit_timeline.unmapped_report(records, mapping).collect()}
    assert got["mapped"]["count"] == 10_000_049 and got["unmapped"]["count"] == 50
    assert (got["mapped"]["q75"], got["mapped"]["max"], got["unmapped"]["q50"]) == (0.0, 49.0, 74.5)
    plan = credit_timeline.unmapped_report(records, mapping)._jdf.queryExecution().toString()
    assert "array_repeat" not in plan


def test_selection_orders_no_values(spark):
    """Histograms only: windows run over cells, every round combines before its exchange."""
    df = spark.range(1000).selectExpr("'x' AS column", "CAST(id AS DOUBLE) AS value")
    plan = quantiles.exact_quantiles(df, "column", "value", [0.5])._jdf.queryExecution().sparkPlan().toString()
    ordered = [line for line in plan.splitlines() if "windowspecdefinition" in line and "ASC" in line]
    assert ordered and all("cell" in line and "v#" not in line.split("windowspecdefinition")[1] for line in ordered)
    assert "percentile" not in plan


def test_no_filter_repeats_the_arithmetic(spark):
    """The joins of the rounds do not check the bits, which are there for every value."""
    df = spark.createDataFrame([("x", 1.0)], "column string, value double")
    plan = quantiles.exact_quantiles(df, "column", "value", [0.5])._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if "Filter" in line]
    assert filters and not any("LOG2" in line.upper() for line in filters)
