"""The physical plans keep their promises."""

import re
import time

import pytest

from loanloom.operators import quality
from loanloom.operators.blocks import card_activity, cash_pos, credit_summary, credit_timeline
from loanloom.plans.scoring import payload_features
from loanloom.plans.wide import feature_blocks, wide_features
from loanloom.queries import features, models, rules
from loanloom.sources import payload
from loanloom.sources.adapters import lending_tables
from loanloom.sources.request_views import requests
from loanloom.sources.shared import written


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|single|Single|RoundRobin)", text))


def stored(spark, sf):
    """The tables as plain Parquet, so that plans show no adapter joins."""
    return {n: written(df, n) for n, df in lending_tables(spark, sf).items()}


def test_plans(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = stored(spark, sf)
        blocks = feature_blocks(t, closed_labels=True)
        # One shuffle per block, and one more for the recent means and two narrow ones
        # for the distinct loans. The timeline has two levels and a mapping that may be
        # split; prior loans read their range through a one-row subquery that is shown
        # twice.
        counts = {n: exchanges(plan(b)) for n, b in blocks.items()}
        assert counts == {
            "credit_summary": 1,
            "credit_timeline": 5,
            "cash_pos_records": 3,
            "card_activity": 2,
            "prior_loan_history": 3,
            "installment_records": 1,
        }
        wide = plan(wide_features(t, closed_labels=True))
        # The distinct customers, and both sides of the last join.
        assert exchanges(wide) == sum(counts.values()) + 3
        assert "NestedLoop" not in wide and "Cartesian" not in wide
        assert "Python" not in wide
        # Labels outside their domains cost one narrow exchange for each aggregate with modes
        # (the timeline has two), and no scan or join.
        default = plan(wide_features(t))
        assert exchanges(default) == exchanges(wide) + 6
        for step in ("SortMergeJoin", "Scan parquet"):
            assert default.count(step) == wide.count(step)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_aggregates_stay_hash_based(spark, sf):
    t = stored(spark, sf)
    for block in (credit_summary.block(t["credit_summary"], closed_labels=True),
                  cash_pos.block(t["cash_pos_records"], closed_labels=True)):
        text = plan(block)
        assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_recent_rows_are_cut_before_the_shuffle(spark, sf):
    text = plan(card_activity.last_months(stored(spark, sf)["card_activity"]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_scans_read_only_what_they_use(spark, sf):
    summary = stored(spark, sf)["credit_summary"]
    text = plan(credit_timeline.record_customer_map(summary))
    assert "ReadSchema: struct<CUSTOMER_ID:bigint,CREDIT_RECORD_ID:bigint>" in text
    assert "IsNotNull(CUSTOMER_ID)" in text


def test_routed_requests_are_shuffled_once(spark, sf):
    """The move into buckets is the only one: blocks, recent rows, loans and joins need none."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        routed = payload.route(requests(spark, sf), buckets=4)
        for closed in (True, False):
            text = plan(payload_features(routed, closed_labels=closed))
            assert "Exchange" not in text
            # The distinct loans and the recent means are joined within their blocks.
            assert text.count("SortMergeJoin") == 2 and text.count("ShuffledHashJoin") == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joined_columns(node) -> list[int]:
    """How many columns each join of a plan hands on."""
    below = node.children()
    found = [n for i in range(below.size()) for n in joined_columns(below.apply(i))]
    return [*found, node.output().size()] if node.nodeName() == "Join" else found


def test_blocks_meet_as_one_column_each(spark, sf):
    """Of several hundred columns, each join would copy all in code that the JVM does not compile."""
    routed = payload.route(requests(spark, sf), buckets=4)
    for df in (payload_features(routed), wide_features(stored(spark, sf), closed_labels=True)):
        assert len(df.columns) > 300
        # The widest are joins within a block: its main aggregate and its recent means or loans.
        assert max(joined_columns(df._jdf.queryExecution().optimizedPlan())) < 130


def test_column_profile_joins_its_table_once(spark, sf):
    """Numbers and labels of a table that comes from a join are read in the same pass."""
    rows = lending_tables(spark, sf)["cash_pos_records"]
    text = plan(quality.column_profile(rows, "cash_pos_records"))
    joins = re.findall(r"\b(?:SortMerge|BroadcastHash|ShuffledHash)Join\b", text)
    assert len(joins) == 1


def test_column_profile_of_odd_columns(spark):
    rows = spark.createDataFrame(
        [("b", None, 1, True), ("", None, None, None), (None, None, 3, False), ("b", None, 3, True)],
        "label string, never string, n bigint, flag boolean",
    )
    found = {r["column"]: r for r in quality.column_profile(rows, "t").collect()}
    assert sorted(found) == ["label", "n"]
    assert found["label"]["categories"] == ["", "b"] and found["label"]["min"] is None
    assert (found["n"]["min"], found["n"]["max"], found["n"]["categories"]) == (1.0, 3.0, None)
    none = {r["column"]: r for r in quality.column_profile(rows.filter("false"), "t").collect()}
    assert sorted(none) == ["n"] and none["n"]["mean"] is None


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_")}


def test_staged_tables_leave_no_shuffle_files(spark):
    """Nothing reads them again, and the jobs that follow need the disk."""
    before = shuffle_files(spark)
    counts = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    assert len(counts.collect()) == 7
    for _ in range(50):  # files go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


@pytest.mark.parametrize("query", [features.wide, features.wide_features_compat, models._training_set])
def test_wide_queries_make_one_block_at_a_time(spark, sf, query, monkeypatch):
    """Only the distinct customers and both sides of the last join are left to move, no raw rows."""
    monkeypatch.setattr(models.training, "training_set", lambda wide: wide)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(query(spark, sf))
        assert exchanges(text) == 3 and "lineitem" not in text
        assert len(re.findall(r"\bBucketed: true", text)) >= 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quality_report_makes_one_block_at_a_time(spark, sf):
    assert exchanges(plan(rules.quality_report(spark, sf))) == 0
