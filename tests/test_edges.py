"""Hand-made edge cases of every operator."""

import math

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from loanloom.functions.binning import equal_width_bin, loan_age_group
from loanloom.functions.cleaning import (
    integer_id,
    nan_to_null,
    to_bigint,
    typed_amount,
    with_clean_id,
)
from loanloom.operators import alignment, labels, quality, risk
from loanloom.operators.alignment import FeatureSchema
from loanloom.operators.blocks import (
    card_activity,
    cash_pos,
    credit_summary,
    credit_timeline,
    installments,
    prior_loans,
)
from loanloom.operators.grouped import grouped
from loanloom.operators.recent import recent_means
from loanloom.schemas import LABELS, TABLE_COLUMNS, table_schema

pytestmark = pytest.mark.usefixtures("interpreted")


def frame(spark, table, records):
    """Rows of a raw table given as dicts; absent columns are NULL."""
    schema = table_schema(table)
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in records], schema)


def only(df):
    (row,) = df.collect()
    return row.asDict()


def test_dirty_ids(spark):
    df = spark.createDataFrame(
        [(None,), ("abc",), ("12",), ("1.5",), ("2.0",), (" 7 ",), ("12d",), ("9007199254740993",)],
        "CUSTOMER_ID string",
    )
    got = [r[0] for r in df.select(integer_id(df)).collect()]
    assert got == [None, None, 12, None, 2, 7, None, 9007199254740993]
    states = [r[0] for r in with_clean_id(df).select("id_state").collect()]
    assert states == ["missing", "missing", "ok", "quarantined", "ok", "ok", "missing", "ok"]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([("0.5",), ("1.5",), ("2.5",), ("x",), ("1e99",)], "x string")
    assert [r[0] for r in df.select(to_bigint(df, "x")).collect()] == [0, 2, 2, None, None]
    nums = spark.createDataFrame([(0.5,), (2.5,), (float("nan"),)], "x double")
    assert [r[0] for r in nums.select(to_bigint(nums, "x")).collect()] == [0, 2, None]


def test_null_keys_form_no_group(spark):
    df = frame(spark, "credit_summary", [{"CUSTOMER_ID": None}, {"CUSTOMER_ID": 1}])
    assert [r[0] for r in credit_summary.block(df).select("CUSTOMER_ID").collect()] == [1]


@pytest.mark.parametrize("closed", [True, False])
def test_mode_ties_nulls_and_single(spark, closed):
    df = spark.createDataFrame(
        [(1, "b"), (1, "a"), (2, None), (3, "b"), (3, None), (4, "a"), (4, "b"), (4, "b")],
        "k long, v string",
    )
    got = grouped(df, ["k"], {}, {"m": "v"}, labels={"v": ["a", "b"]}, closed_labels=closed)
    assert rows(got, "k") == [(1, "a"), (2, "Unknown"), (3, "b"), (4, "b")]


def test_mode_outside_the_domain(spark):
    data = [(1, "z"), (1, "z"), (1, "a"), (2, "a"), (2, "Z"), (3, "z"), (4, "it's"), (5, "b")]
    df = spark.createDataFrame(data, "k long, v string")
    for domain in (["a", "b"], []):
        got = grouped(df, ["k"], {"n": "count(1)"}, {"m": "v"}, labels={"v": domain})
        assert rows(got, "k") == [
            (1, 3, "z"),
            (2, 2, "Z"),
            (3, 1, "z"),
            (4, 1, "it's"),
            (5, 1, "b"),
        ]


def test_sums_means_and_ratios_of_nothing(spark):
    row = only(
        credit_summary.block(
            frame(
                spark,
                "credit_summary",
                [
                    {"CUSTOMER_ID": 1, "TOTAL_CREDIT_AMOUNT": 0.0, "OUTSTANDING_DEBT": 5.0},
                    {"CUSTOMER_ID": 1},
                ],
            )
        )
    )
    assert row["credit_summary_DEBT_CREDIT_RATIO"] == 0.0
    assert row["credit_summary_agg_CREDIT_LIMIT_sum"] == 0.0
    assert row["credit_summary_agg_CREDIT_LIMIT_mean"] is None
    assert row["credit_summary_NUM_LOANS"] == 0
    assert row["credit_summary_PERCENT_ACTIVE"] == 0.0
    assert row["credit_summary_HAS_BAD_DEBT"] == 0
    assert row["credit_summary_MOST_COMMON_TYPE_OF_CREDIT"] == "Unknown"
    assert row["credit_summary_AVG_CREDIT_AGE"] is None


def test_fixed_age_bins(spark):
    values = [-101, -100, -99, -48, -47, -24, -23, 0, 1, None]
    a, b, c = LABELS["LOAN_AGE_GROUP"]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = [r[0] for r in df.select(loan_age_group(F.col("x"))).collect()]
    assert got == [None, None, a, a, b, b, c, c, None, None]


@pytest.mark.parametrize(
    "values",
    [list(range(21)), [5], [5, 5, None], [-3000, -1, -17, -2999, -1500, None, -150, -151]],
)
def test_equal_width_bins_match_pandas_cut(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "DAYS_SINCE_DECISION long")
    got = [r[1] for r in prior_loans.with_decision_bin(df).collect()]
    cut = pd.cut(pd.Series(values, dtype="float"), bins=20, labels=False)
    assert got == [None if math.isnan(v) else int(v) for v in cut]


def test_equal_width_bins_of_doubles(spark):
    values = [0.0, 0.5, 3.25, 9.99, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bins = equal_width_bin(F.col("x"), F.lit(0.0), F.lit(10.0), integral=False)
    cut = pd.cut(pd.Series(values), bins=20, labels=False)
    assert [r[0] for r in df.select(bins).collect()] == [int(v) for v in cut]


def test_all_null_bins(spark):
    df = spark.createDataFrame([(None,), (None,)], "DAYS_SINCE_DECISION long")
    assert [r[1] for r in prior_loans.with_decision_bin(df).collect()] == [None, None]


def test_deviation_of_one_and_two_rows(spark):
    df = frame(
        spark,
        "prior_loan_history",
        [
            {"CUSTOMER_ID": 1, "REQUESTED_LOAN_AMOUNT": 10.0},
            {"CUSTOMER_ID": 2, "REQUESTED_LOAN_AMOUNT": 10.0},
            {"CUSTOMER_ID": 2, "REQUESTED_LOAN_AMOUNT": 20.0},
        ],
    )
    got = prior_loans.block(df).select("CUSTOMER_ID", "prior_loan_STD_APPLICATION_AMOUNT")
    (_, one), (_, two) = rows(got, "CUSTOMER_ID")
    assert one == 0.0 and two == pytest.approx(math.sqrt(50))


def test_proportion_counts_nulls_as_false(spark):
    df = frame(
        spark,
        "prior_loan_history",
        [{"CUSTOMER_ID": 1, "DAYS_UNTIL_FINAL_PAYMENT": v} for v in (-1.0, 1.0, None, None)],
    )
    row = only(prior_loans.block(df))
    assert row["prior_loan_PROPORTION_OVERDUE_APPLICATIONS"] == 0.25


@pytest.mark.parametrize("n", [1, 5, 6, 7, 12, 13])
def test_recent_means(spark, n):
    values = [float(i) if i % 4 else None for i in range(n)]
    df = spark.createDataFrame([(1, -i, i, v) for i, v in enumerate(values)], "k long, t long, i long, v double")
    got = only(recent_means(df, ["k"], ["t", "i"], {"six": ("v", 6), "all": ("v", 12)}))

    def mean(part):
        known = [v for v in part if v is not None]
        return sum(known) / len(known) if known else None

    assert got["six"] == mean(values[:6]) and got["all"] == mean(values[:12])


def test_worst_status(spark):
    data = [(1, "x"), (2, None), (3, "On Time"), (3, "Defaulted"), (4, "Delayed"), (4, "x")]
    df = spark.createDataFrame(data, "CREDIT_RECORD_ID long, ACCOUNT_STATUS string")
    got = credit_timeline.max_overdue_status(df)
    assert rows(got, "CREDIT_RECORD_ID") == [
        (1, "On Time"),
        (2, "On Time"),
        (3, "Defaulted"),
        (4, "Delayed"),
    ]


def test_record_mapping(spark):
    summary = frame(
        spark,
        "credit_summary",
        [
            {"CUSTOMER_ID": 1, "CREDIT_RECORD_ID": 10},
            {"CUSTOMER_ID": 1, "CREDIT_RECORD_ID": 10},
            {"CUSTOMER_ID": 2, "CREDIT_RECORD_ID": 10},
            {"CUSTOMER_ID": None, "CREDIT_RECORD_ID": 11},
        ],
    )
    timeline = frame(
        spark,
        "credit_timeline",
        [
            {"CREDIT_RECORD_ID": r, "TIME_SINCE_ENTRY": -3, "ACCOUNT_STATUS": "Frozen"}
            for r in (10, 11, 12)
        ],
    )
    mapping = credit_timeline.record_customer_map(summary)
    assert rows(mapping, "CUSTOMER_ID") == [(10, 1), (10, 2)]
    out = credit_timeline.block(timeline, summary)
    label = "credit_timeline_MOST_COMMON_STATUS_most_frequent"
    assert rows(out.select("CUSTOMER_ID", label), "CUSTOMER_ID") == [(1, "Frozen"), (2, "Frozen")]
    compat = credit_timeline.block(timeline, summary, compat_names=True)
    assert "credit_timeline_MOST_COMMON_STATUS_<lambda>" in compat.columns


def test_payment_flags_and_fills(spark):
    df = frame(
        spark,
        "installment_records",
        [
            {
                "CUSTOMER_ID": 1,
                "PRIOR_LOAN_ID": 5,
                "DAYS_UNTIL_DUE": -10,
                "DAYS_BEFORE_ACTUAL_PAYMENT": -8,
                "SCHEDULED_PAYMENT_AMOUNT": 0.0,
                "ACTUAL_PAYMENT_AMOUNT": 3.0,
            },
            {"CUSTOMER_ID": 1, "ACTUAL_PAYMENT_AMOUNT": 0.0, "DAYS_UNTIL_DUE": -40},
        ],
    )
    flags = rows(installments.with_row_flags(df).select(*installments.ROW_FLAGS), "PAYMENT_DELAY")
    assert flags == [(None, 1, 0, None), (None, 0, 1, 2)]
    row = only(installments.block(df))
    assert row["installments_agg_PAYMENT_RATIO_mean"] == 1.0
    assert row["installments_agg_PAYMENT_RATIO_sum"] == 0.0
    assert row["installments_STD_PAYMENT_DELAY"] == 0.0
    assert row["installments_MEAN_PAYMENT_DELAY"] == 2.0
    assert row["installments_ABS_MEAN_PAYMENT_DELAY"] == 17.0
    assert row["installments_PAYMENT_COMPLIANCE_RATIO"] == 0.0


def test_block_widths_with_all_columns(spark):
    """Feature counts of the full raw tables."""
    t = {name: frame(spark, name, []) for name in TABLE_COLUMNS}
    widths = {
        "credit_summary": credit_summary.block(t["credit_summary"]),
        "credit_timeline": credit_timeline.block(t["credit_timeline"], t["credit_summary"]),
        "card_activity": card_activity.block(t["card_activity"]),
        "cash_pos": cash_pos.block(t["cash_pos_records"]),
        "installments": installments.block(t["installment_records"]),
        "installments_compat": installments.block(t["installment_records"], compat_names=True),
        "prior_loan": prior_loans.block(t["prior_loan_history"]),
    }
    assert {k: len(v.columns) - 1 for k, v in widths.items()} == {
        "credit_summary": 55,
        "credit_timeline": 59,
        "card_activity": 98,
        "cash_pos": 35,
        "installments": 61,
        "installments_compat": 85,
        "prior_loan": 102,
    }


def test_types_and_fills(spark):
    df = spark.createDataFrame(
        [("0.5", "1.5x", "Housing A"), ("2.5", "7", "Castle"), (None, None, None)],
        "n string, x string, h string",
    )
    schema = FeatureSchema(
        ["n", "x", "h", "gone"],
        {"n": "Int64", "x": "float64", "h": "category", "gone": "float64"},
        {"h": LABELS["HOUSING_TYPE"]},
    )
    typed = alignment.enforce_types(alignment.align(df, schema.features), schema)
    assert rows(typed) == [
        (0, None, "Housing A", 0.0),
        (2, 7.0, None, 0.0),
        (None, None, None, 0.0),
    ]
    assert rows(alignment.fill_scoring(typed))[2] == (None, None, "Missing", 0.0)
    assert rows(alignment.fill_training(typed))[2] == (0, 0.0, "Missing", 0.0)


def test_large_domain_is_joined(spark):
    domain = [f"L{i}" for i in range(300)]
    df = spark.createDataFrame([(1, "L7"), (2, "no")], "k long, v string")
    schema = FeatureSchema(["k", "v"], {"k": "int64", "v": "category"}, {"v": domain})
    assert rows(alignment.enforce_types(df, schema), "k") == [(1, "L7"), (2, None)]


def test_quality_counts(spark):
    inf = float("inf")
    df = spark.createDataFrame(
        [("", 1.0), ("nan", float("nan")), (None, None), ("x", inf), ("y", -inf)],
        "s string, d double",
    )
    got = {r["column"]: tuple(r)[2:] for r in quality.quality_report(df, "t").collect()}
    assert got == {"s": (5, 1, 2, 0), "d": (5, 2, 0, 2)}
    assert nan_to_null(df).filter("d IS NULL").count() == 2


def test_affordability_limits(spark):
    data = [(100.0, 300.0, 10), (100.0, 301.0, 10), (100.0, 299.0, 10), (0.0, 300.0, 10),
            (100.0, 0.0, 10), (100.0, 300.0, 0), (None, 300.0, 10)]
    df = spark.createDataFrame(data, "MONTHLY_INCOME double, LOAN_AMOUNT double, LOAN_TERM_MONTHS long")
    got = [(r.dti_accepted, r.dti_warning) for r in risk.with_dti(df).collect()]
    message = "DTI ratio too high (30.1%). Please choose a lower loan amount."
    assert got == [(True, ""), (False, message), *[(True, "")] * 5]
    cap = risk.capped_loan(*[F.col(c) for c in df.columns])
    capped = [r[0] for r in df.select(cap).collect()]
    assert capped == [300.0, 300.0, 299.0, 300.0, 0.0, 300.0, 300.0]


def test_typed_amounts(spark):
    df = spark.createDataFrame([("1,234",), ("12x",), ("",), (" 5 ",)], "t string")
    got = [r[0] for r in df.select(typed_amount(F.col("t"), F.lit(9))).collect()]
    assert got == [1234.0, 9.0, 0.0, 5.0]


def test_decision_texts(spark):
    df = spark.createDataFrame([(0.5,), (0.50004,), (0.9,)], "default_probability double")
    got = [
        (r.prediction, r.formatted_probability, r.score_class)
        for r in risk.with_decision(df).collect()
    ]
    assert got == [
        (0, "50.00%", "low-risk"),
        (1, "50.00%", "low-risk"),
        (1, "90.00%", "high-risk"),
    ]


@pytest.mark.parametrize("n", [1, 3, 4, 40, 1000])
def test_split_sizes(spark, n):
    df = spark.range(n).selectExpr("id - 5 AS CUSTOMER_ID", "id % 3 % 2 AS TARGET")
    out = labels.stratified_split(df)
    assert out.count() == n
    sizes = {tuple(r)[:2]: r[2] for r in out.groupBy("TARGET", "split").count().collect()}
    totals = {r[0]: r[1] for r in df.groupBy("TARGET").count().collect()}
    for target, count in totals.items():
        assert sizes.get((target, "validation"), 0) == count // 4


def test_auc_with_ties(spark):
    df = spark.createDataFrame(
        [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)], "p double, TARGET long"
    )
    wins = sum(
        1.0 if a > b else 0.5 if a == b else 0.0 for a in (0.4, 0.8, 0.9) for b in (0.1, 0.4, 0.8)
    )
    assert labels.roc_auc(df, "p") == pytest.approx(wins / 9)
