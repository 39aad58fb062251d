"""Credit records of other lenders: amounts, ages, overdue state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanloom.functions.aggregates import (
    any_flag,
    mean,
    prefixed,
    quoted,
    safe_ratio,
    share,
    total,
    years,
)
from loanloom.operators.blocks.generic import modes_of, stats_of
from loanloom.operators.grouped import grouped
from loanloom.schemas import CUSTOMER, LABELS

PREFIX = "credit_summary"
IS_ACTIVE, IS_REPAID, IS_WRITTEN_OFF = (
    f"CREDIT_STATUS = {quoted(label)}" for label in LABELS["CREDIT_STATUS"]
)

MEASURES = prefixed(
    PREFIX,
    {
        "NUM_LOANS": "count(CREDIT_RECORD_ID)",
        "NUM_ACTIVE_LOANS": f"count_if({IS_ACTIVE})",
        "NUM_CLOSED_LOANS": f"count_if({IS_REPAID})",
        "TOTAL_CREDIT_AMOUNT": total("TOTAL_CREDIT_AMOUNT"),
        "AVG_CREDIT_AMOUNT": mean("TOTAL_CREDIT_AMOUNT"),
        "TOTAL_DEBT": total("OUTSTANDING_DEBT"),
        "DEBT_CREDIT_RATIO": safe_ratio(total("OUTSTANDING_DEBT"), total("TOTAL_CREDIT_AMOUNT")),
        "AVG_CREDIT_AGE": years(mean("DAYS_SINCE_CREDIT_ISSUED")),
        "TIME_SINCE_LAST_UPDATE": years("max(DAYS_SINCE_CREDIT_UPDATE)"),
        "AVG_REMAINING_CREDIT_TIME": years(mean("DAYS_UNTIL_CREDIT_END")),
        "NUM_OVERDUE_LOANS": "count_if(DAYS_OVERDUE > 0)",
        "TOTAL_OVERDUE_AMOUNT": total("OVERDUE_BALANCE"),
        "PERCENT_ACTIVE": share(IS_ACTIVE),
        "HAS_BAD_DEBT": any_flag(IS_WRITTEN_OFF),
    },
)
MODES = {f"{PREFIX}_MOST_COMMON_TYPE_OF_CREDIT": "TYPE_OF_CREDIT"}


def features(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    return grouped(df, list(keys), MEASURES, MODES, closed_labels=closed_labels)


def block(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys = list(keys)
    return grouped(
        df,
        keys,
        {**stats_of(df, keys, PREFIX), **MEASURES},
        {**modes_of(df, keys, PREFIX), **MODES},
        closed_labels=closed_labels,
    )
