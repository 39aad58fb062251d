"""Results do not depend on partitioning, and a hot key changes nothing but the load."""

import pytest
from compare import differences, spark_table
from pyspark.sql import functions as F

from loanloom.operators.blocks import (
    card_activity,
    cash_pos,
    credit_summary,
    credit_timeline,
    prior_loans,
)
from loanloom.operators.skew import join_unique
from loanloom.plans import training
from loanloom.plans.wide import merge_blocks, wide_features
from loanloom.queries.common import as_double
from loanloom.sources.adapters import lending_tables

pytestmark = pytest.mark.usefixtures("interpreted")


@pytest.fixture(scope="module")
def exact(spark, sf):
    return lending_tables(spark, sf, exact=True)


@pytest.mark.parametrize(
    "module, name",
    [
        (card_activity, "card_activity"),
        (cash_pos, "cash_pos_records"),
        (credit_summary, "credit_summary"),
        (prior_loans, "prior_loan_history"),
    ],
)
def test_partitions_do_not_matter(exact, module, name):
    def result(n):
        block = module.block(exact[name].repartition(n))
        loose = [c for c in block.columns if "_STD_" in c]
        return spark_table(block.drop(*loose))

    first = result(1)
    for n in (8, 64):
        assert differences(result(n), first) == []


def test_double_and_decimal_money_agree(spark, sf, exact):
    left = wide_features(exact, closed_labels=True)
    right = wide_features(lending_tables(spark, sf), closed_labels=True)
    lc, lrows = spark_table(as_double(left))
    rc, rrows = spark_table(right)
    assert lc == rc and len(lrows) == len(rrows)
    key = lc.index("CUSTOMER_ID")
    other = {r[key]: r for r in rrows}
    for row in lrows:
        for name, a, b in zip(lc, row, other[row[key]]):
            if isinstance(a, float) and isinstance(b, float):
                assert a == pytest.approx(b, rel=1e-7, abs=1e-6), name
            else:
                assert a == b, name


def test_wide_has_one_row_per_profile(spark, exact):
    profile = exact["customer_profile"]
    keyless = profile.limit(3).withColumn("CUSTOMER_ID", F.lit(None).cast("bigint"))
    tables = {**exact, "customer_profile": profile.unionByName(keyless)}
    wide = wide_features(tables, closed_labels=True)
    assert wide.count() == profile.count() + 3
    assert "TARGET" not in wide.columns
    assert wide.filter("CUSTOMER_ID IS NULL AND credit_summary_NUM_LOANS IS NULL").count() == 3


def test_open_and_closed_labels_agree(exact):
    block = credit_summary.block
    table = exact["credit_summary"]
    assert differences(spark_table(block(table)), spark_table(block(table, closed_labels=True))) == []


def test_status_counts_add_up(exact):
    block = prior_loans.block(exact["prior_loan_history"])
    parts = "prior_loan_NUM_APPROVED_LOANS + prior_loan_NUM_REFUSED_LOANS + prior_loan_NUM_CANCELED_LOANS"
    assert block.filter(f"{parts} <> prior_loan_NUM_APPLICATIONS").count() == 0
    assert block.filter("NOT prior_loan_APPROVAL_RATE BETWEEN 0 AND 1").count() == 0


def test_hot_customer(spark, exact):
    """A third of all card rows under one customer: compare with brute force."""
    cards = exact["card_activity"]
    hot = cards.withColumn(
        "CUSTOMER_ID",
        F.when(F.col("PRIOR_LOAN_ID") % 3 == 0, F.lit(-1)).otherwise(F.col("CUSTOMER_ID")),
    )
    got = {r["CUSTOMER_ID"]: r for r in card_activity.block(hot.repartition(16)).collect()}
    data = {}
    for r in hot.collect():
        data.setdefault(r["CUSTOMER_ID"], []).append(r)
    assert set(got) == set(data)
    for key, records in data.items():
        records.sort(key=lambda r: (r["TIME_SINCE_ENTRY"], r["PRIOR_LOAN_ID"]), reverse=True)
        assert got[key]["card_activity_NUM_CREDIT_CARDS"] == len(records)
        for n in (6, 12):
            known = [r["CURRENT_CARD_BALANCE"] for r in records[:n]]
            known = [float(v) for v in known if v is not None]
            expected = sum(known) / len(known) if known else None
            assert got[key][f"card_activity_AVG_BALANCE_LAST_{n}M"] == pytest.approx(expected)


def test_hot_label_outside_the_domain(spark, exact):
    """Unknown labels, a third of them on one customer, still win when most frequent."""
    summary = exact["credit_summary"].withColumn(
        "CUSTOMER_ID",
        F.when(F.col("CREDIT_RECORD_ID") % 3 == 0, F.lit(-1)).otherwise(F.col("CUSTOMER_ID")),
    ).withColumn("CREDIT_STATUS", F.concat(F.lit("New "), F.col("CREDIT_RECORD_ID") % 5))
    got = credit_summary.block(summary)
    name = "credit_summary_agg_CREDIT_STATUS_most_frequent"
    modes = {r["CUSTOMER_ID"]: r[name] for r in got.select("CUSTOMER_ID", name).collect()}
    counts = {}
    for r in summary.select("CUSTOMER_ID", "CREDIT_STATUS").collect():
        group = counts.setdefault(r[0], {})
        group[r[1]] = group.get(r[1], 0) + 1
    best = {k: min(v, key=lambda label: (-v[label], label)) for k, v in counts.items()}
    assert modes == best


def test_many_hot_profiles_and_records(spark, exact):
    """Thousands of frequent keys: every row comes out once, with its own partner."""
    many = spark.range(40_000).select(
        F.pmod("id", F.lit(2_000)).alias("CUSTOMER_ID"), F.col("id").alias("n")
    ).unionByName(spark.range(20_000).select(F.lit(1).cast("bigint").alias("CUSTOMER_ID"), F.col("id").alias("n")))
    unique = spark.range(3_000).select(F.col("id").alias("CUSTOMER_ID"), (F.col("id") * 2).alias("v"))
    out = join_unique(many, unique, ["CUSTOMER_ID"], "left")
    assert out.columns == ["CUSTOMER_ID", "n", "v"]
    assert out.count() == 60_000 and out.filter("v <> CUSTOMER_ID * 2 OR v IS NULL").count() == 0

    profile = exact["customer_profile"].drop("TARGET")
    block = credit_summary.block(exact["credit_summary"], closed_labels=True)
    repeated = profile.unionByName(profile.filter("CUSTOMER_ID % 7 = 0"))
    plain = repeated.join(block, "CUSTOMER_ID", "left")
    merged = merge_blocks(repeated, [block])
    assert differences(spark_table(merged), spark_table(plain)) == []

    records = credit_timeline.per_record(exact["credit_timeline"])
    shared = exact["credit_summary"].withColumn(
        "CREDIT_RECORD_ID",
        F.when(F.col("CREDIT_RECORD_ID") % 3 == 0, F.lit(1)).otherwise(F.col("CREDIT_RECORD_ID")),
    )
    mapping = credit_timeline.record_customer_map(shared)
    mapped = credit_timeline.map_to_customers(records, mapping)
    plain = records.join(mapping, "CREDIT_RECORD_ID").select(*mapped.columns)
    assert differences(spark_table(mapped), spark_table(plain)) == []
    assert mapped.filter("CREDIT_RECORD_ID = 1").count() > 10


def test_frequent_keys_are_split(spark):
    """Both sides are shuffled for the join itself, which adaptive execution can split."""
    many = spark.range(100).select((F.col("id") % 3).alias("k"))
    unique = spark.range(5).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = join_unique(many, unique, ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("hashpartitioning(__spread") == 2


def test_stray_label_fails_a_closed_query(exact):
    table = exact["credit_summary"].withColumn("CREDIT_STATUS", F.lit("Frozen"))
    block = credit_summary.block(table, closed_labels=True)
    with pytest.raises(Exception, match="CREDIT_STATUS has a label outside its domain"):
        block.collect()
    name = "credit_summary_agg_CREDIT_STATUS_most_frequent"
    assert {r[0] for r in credit_summary.block(table).select(name).collect()} == {"Frozen"}


def test_training_rows_are_profile_rows(exact):
    """Customers with several profile rows train once for each, not once for each pair."""
    profile = exact["customer_profile"]
    repeated = profile.unionByName(profile.filter("CUSTOMER_ID % 5 = 0"))
    few = {"customer_profile": repeated, "credit_summary": exact["credit_summary"]}
    data = training.training_set(wide_features(few, keep_target=True))
    assert data.rows.count() == repeated.count()
