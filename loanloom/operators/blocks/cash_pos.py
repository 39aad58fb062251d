"""Point-of-sale and cash loan months: age tiers, activity, overdue days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggregates import any_flag, int_total, mean, prefixed, quoted, share
from loanloom.functions.binning import loan_age_group
from loanloom.operators.blocks.generic import modes_of, stats_of
from loanloom.operators.grouped import grouped, with_keys
from loanloom.schemas import CUSTOMER, LABELS, LOAN

PREFIX = "cash_pos"
IS_ACTIVE, IS_COMPLETED, IS_RETURNED = (
    f"CONTRACT_STATUS = {quoted(label)}" for label in LABELS["CONTRACT_STATUS"]
)

MEASURES = prefixed(
    PREFIX,
    {
        "NUM_ACTIVE_POS_LOANS": f"count_if({IS_ACTIVE})",
        "NUM_COMPLETED_POS_LOANS": f"count_if({IS_COMPLETED})",
        "AVG_POS_CREDIT_DURATION": f"abs({mean('TIME_SINCE_ENTRY')}) / 12D",
        "TIME_SINCE_LAST_POS_UPDATE": "abs(max(TIME_SINCE_ENTRY)) / 12D",
        "AVG_REMAINING_INSTALLMENT_TIME": f"abs({mean('REMAINING_TERM_MONTHS')})",
        "NUM_OVERDUE_POS_CREDITS": "count_if(DAYS_PAST_DUE > 0)",
        "TOTAL_OVERDUE_DAYS_POS": int_total("DAYS_PAST_DUE"),
        "MAX_OVERDUE_DAYS_POS": "max(DAYS_PAST_DUE)",
        "NUM_SEVERE_OVERDUE_POS": "count_if(DAYS_PAST_DUE_90 > 0)",
        "PERCENT_ACTIVE_MONTHS": share(IS_ACTIVE),
        "HAS_RETURNED_CONTRACT": any_flag(IS_RETURNED),
    },
)
MODES = {
    f"{PREFIX}_agg_LOAN_AGE_GROUP_most_frequent": "LOAN_AGE_GROUP",
    f"{PREFIX}_MOST_COMMON_CONTRACT_STATUS": "CONTRACT_STATUS",
}


def with_age_group(df: DataFrame) -> DataFrame:
    return df.withColumn("LOAN_AGE_GROUP", loan_age_group(F.col("TIME_SINCE_ENTRY")))


def with_loans(out: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Add the number of distinct loans.

    Only (key, loan) pairs are made distinct; beside the other aggregates the distinct
    count would carry all their buffers through a second shuffle.
    """
    pairs = with_keys(df.select(*keys, LOAN), keys).distinct()
    loans = pairs.groupBy(*keys).agg(F.count(LOAN).alias(f"{PREFIX}_NUM_POS_LOANS"))
    return out.join(loans, keys, "left")


def features(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys = list(keys)
    out = grouped(with_age_group(df), keys, MEASURES, MODES, closed_labels=closed_labels)
    return with_loans(out, df, keys)


def block(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys = list(keys)
    out = grouped(
        with_age_group(df),
        keys,
        {**stats_of(df, keys, PREFIX), **MEASURES},
        {**modes_of(df, keys, PREFIX), **MODES},
        closed_labels=closed_labels,
    )
    return with_loans(out, df, keys)
