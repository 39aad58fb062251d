"""Monthly card statements: balances, limits, recent averages, days past due."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loanloom.functions.aggregates import int_total, prefixed, quoted, safe_ratio, share, total
from loanloom.operators.blocks.generic import modes_of, stats_of
from loanloom.operators.grouped import grouped
from loanloom.operators.recent import recent_means
from loanloom.schemas import CUSTOMER, LABELS, LOAN

PREFIX = "card_activity"
IS_ACTIVE, IS_COMPLETED, _ = (
    f"CONTRACT_STATUS = {quoted(label)}" for label in LABELS["CONTRACT_STATUS"]
)

MEASURES = prefixed(
    PREFIX,
    {
        "NUM_CREDIT_CARDS": f"count({LOAN})",
        "NUM_ACTIVE_CARDS": f"count_if({IS_ACTIVE})",
        "NUM_CLOSED_CARDS": f"count_if({IS_COMPLETED})",
        "TOTAL_CREDIT_LIMIT": int_total("CARD_CREDIT_LIMIT"),
        "TOTAL_CREDIT_BALANCE": total("CURRENT_CARD_BALANCE"),
        "TOTAL_DEBT": total("RECEIVABLE_BALANCE"),
        "CREDIT_UTILIZATION_RATIO": safe_ratio(
            total("CURRENT_CARD_BALANCE"), int_total("CARD_CREDIT_LIMIT")
        ),
        "TOTAL_OVERDUE": total("PRINCIPAL_DUE"),
        "NUM_DPD_0_30": "count_if(DAYS_PAST_DUE > 0 AND DAYS_PAST_DUE <= 30)",
        "NUM_DPD_30_90": "count_if(DAYS_PAST_DUE > 30 AND DAYS_PAST_DUE <= 90)",
        "NUM_DPD_90_PLUS": "count_if(DAYS_PAST_DUE > 90)",
        "STATUS_ACTIVE_RATIO": share(IS_ACTIVE),
        "STATUS_COMPLETED_RATIO": share(IS_COMPLETED),
    },
)
RECENT = {
    f"{PREFIX}_AVG_BALANCE_LAST_6M": ("CURRENT_CARD_BALANCE", 6),
    f"{PREFIX}_AVG_BALANCE_LAST_12M": ("CURRENT_CARD_BALANCE", 12),
    f"{PREFIX}_AVG_PAYMENT_LAST_6M": ("CURRENT_PAYMENT", 6),
    f"{PREFIX}_AVG_PAYMENT_LAST_12M": ("CURRENT_PAYMENT", 12),
}


def last_months(df: DataFrame, keys=(CUSTOMER,)) -> DataFrame:
    """Mean balance and payment over the last 6 and 12 statements of each key."""
    return recent_means(df, list(keys), ["TIME_SINCE_ENTRY", LOAN], RECENT)


def features(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys = list(keys)
    return grouped(df, keys, MEASURES).join(last_months(df, keys), keys, "left")


def block(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    keys = list(keys)
    main = grouped(
        df,
        keys,
        {**stats_of(df, keys, PREFIX), **MEASURES},
        modes_of(df, keys, PREFIX),
        closed_labels=closed_labels,
    )
    return main.join(last_months(df, keys), keys, "left")
