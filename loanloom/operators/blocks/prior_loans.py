"""Past loan applications: approvals, amounts, timing, decision-age bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggregates import (
    any_flag,
    deviation,
    highest,
    lowest,
    mean,
    numeric_stats,
    prefixed,
    quoted,
    safe_ratio,
    share,
    total,
    years,
)
from loanloom.functions.binning import equal_width_bin
from loanloom.operators.blocks.generic import modes_of, stats_of
from loanloom.operators.grouped import grouped
from loanloom.schemas import CUSTOMER, LABELS, LOAN, is_fractional

PREFIX = "prior_loan"
DECISION, BIN = "DAYS_SINCE_DECISION", "DAYS_SINCE_DECISION_BIN"
LOW, HIGH = "__decision_low", "__decision_high"
ASKED, GRANTED = "REQUESTED_LOAN_AMOUNT", "LOAN_AMOUNT"
IS_APPROVED, IS_REFUSED, IS_CANCELED = (
    f"CONTRACT_STATUS = {quoted(label)}" for label in LABELS["CONTRACT_STATUS"]
)
IS_REVOLVING, IS_CASH = (
    f"LOAN_CONTRACT_TYPE = {quoted(label)}" for label in LABELS["LOAN_CONTRACT_TYPE"]
)
IS_REPEATER = f"CLIENT_TYPE = {quoted(LABELS['CLIENT_TYPE'][0])}"

MEASURES = prefixed(
    PREFIX,
    {
        "NUM_APPLICATIONS": f"count({LOAN})",
        "NUM_APPROVED_LOANS": f"count_if({IS_APPROVED})",
        "NUM_REFUSED_LOANS": f"count_if({IS_REFUSED})",
        "NUM_CANCELED_LOANS": f"count_if({IS_CANCELED})",
        "APPROVAL_RATE": share(IS_APPROVED),
        "NUM_REVOLVING_LOANS": f"count_if({IS_REVOLVING})",
        "NUM_CASH_LOANS": f"count_if({IS_CASH})",
        "NUM_REPEAT_LOANS": f"count_if({IS_REPEATER})",
        "TOTAL_APPLICATION_AMOUNT": total(ASKED),
        "AVG_APPLICATION_AMOUNT": mean(ASKED),
        "MAX_APPLICATION_AMOUNT": highest(ASKED),
        "MIN_APPLICATION_AMOUNT": lowest(ASKED),
        "STD_APPLICATION_AMOUNT": deviation(ASKED),
        "TOTAL_APPROVED_AMOUNT": total(GRANTED),
        "AVG_APPROVED_AMOUNT": mean(GRANTED),
        "MAX_APPROVED_AMOUNT": highest(GRANTED),
        "MIN_APPROVED_AMOUNT": lowest(GRANTED),
        "STD_APPROVED_AMOUNT": deviation(GRANTED),
        "TOTAL_PAYMENT_AMOUNT": total("PLANNED_NUM_PAYMENTS"),
        "APPROVAL_AMOUNT_RATIO": safe_ratio(total(GRANTED), total(ASKED)),
        "APPLICATION_TO_CREDIT_RATIO": safe_ratio(total(ASKED), total(GRANTED)),
        "AVG_TIME_SINCE_APPLICATION": years(mean(DECISION)),
        "MAX_TIME_SINCE_APPLICATION": years(f"min({DECISION})"),
        "TIME_SINCE_LAST_APPLICATION": years(f"max({DECISION})"),
        "AVG_LOAN_DURATION": years(mean("DAYS_UNTIL_TERMINATION")),
        "MAX_LOAN_DURATION": years(highest("DAYS_UNTIL_TERMINATION")),
        "AVG_TIME_TO_FIRST_PAYMENT": years(mean("DAYS_UNTIL_FIRST_PAYMENT")),
        "AVG_TIME_REMAINING": years(mean("DAYS_UNTIL_FINAL_PAYMENT")),
        "NUM_OVERDUE_APPLICATIONS": "count_if(DAYS_UNTIL_FIRST_PAYMENT < 0)",
        "TOTAL_OVERDUE_AMOUNT": "count_if(DAYS_UNTIL_FINAL_PAYMENT < 0)",
        "PROPORTION_OVERDUE_APPLICATIONS": share("DAYS_UNTIL_FINAL_PAYMENT < 0"),
        "PERCENT_APPROVED": share(IS_APPROVED),
        "HAS_REFUSALS": any_flag(IS_REFUSED),
    },
)
MODES = {
    f"{PREFIX}_MOST_COMMON_CONTRACT_TYPE": "LOAN_CONTRACT_TYPE",
    f"{PREFIX}_MOST_COMMON_LOAN_PURPOSE": "LOAN_PURPOSE_CATEGORY",
}


def with_decision_bin(df: DataFrame) -> DataFrame:
    """Add the 20-bin code of the decision age.

    The range is that of the whole table, read through a one-row scalar
    subquery, unless the rows already carry the range of their own request
    (``__decision_low`` and ``__decision_high``).
    """
    integral = not is_fractional(df.schema[DECISION].dataType)
    if LOW not in df.columns:
        span = df.agg(F.struct(F.min(DECISION).alias("l"), F.max(DECISION).alias("h"))).scalar()
        df = df.withColumns({LOW: span["l"], HIGH: span["h"]})
    bins = equal_width_bin(F.col(DECISION), F.col(LOW), F.col(HIGH), integral)
    return df.withColumn(BIN, bins).drop(LOW, HIGH)


def features(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys, rows = list(keys), with_decision_bin(df)
    measures = {**numeric_stats(rows, [BIN], PREFIX), **MEASURES}
    return grouped(rows, keys, measures, MODES, closed_labels=closed_labels)


def block(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys, rows = list(keys), with_decision_bin(df)
    return grouped(
        rows,
        keys,
        {**stats_of(rows, keys, PREFIX), **MEASURES},
        {**modes_of(rows, keys, PREFIX), **MODES},
        closed_labels=closed_labels,
    )
