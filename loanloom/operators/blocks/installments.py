"""Installment payments: amounts paid against due, delays, missed and late payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.functions.aggregates import (
    deviation,
    int_total,
    mean,
    numeric_columns,
    prefixed,
    ratio,
    safe_ratio,
    total,
)
from loanloom.operators.blocks.generic import IDENTIFIERS, stats_of
from loanloom.operators.grouped import grouped
from loanloom.schemas import CUSTOMER, LOAN

PREFIX = "installments"
ROW_FLAGS = ["PAYMENT_RATIO", "MISSED_PAYMENT", "LATE_PAYMENT", "PAYMENT_DELAY"]
PAID_DAY, DUE_DAY = "DAYS_BEFORE_ACTUAL_PAYMENT", "DAYS_UNTIL_DUE"
PAID, DUE = "ACTUAL_PAYMENT_AMOUNT", "SCHEDULED_PAYMENT_AMOUNT"


MEASURES = prefixed(
    PREFIX,
    {
        "NUM_PAYMENTS": f"count({LOAN})",
        "NUM_MISSED_PAYMENTS": int_total("MISSED_PAYMENT"),
        "MISSED_PAYMENT_RATIO": mean("MISSED_PAYMENT"),
        "MEAN_INSTALMENT_AMOUNT": mean(DUE),
        "MEAN_ACTUAL_PAYMENT": mean(PAID),
        "SUM_INSTALMENT_AMOUNT": total(DUE),
        "SUM_ACTUAL_PAYMENT": total(PAID),
        "PAYMENT_COMPLIANCE_RATIO": safe_ratio(total(PAID), total(DUE)),
        "MEAN_DAYS_ENTRY_PAYMENT": mean(PAID_DAY),
        "STD_DAYS_ENTRY_PAYMENT": deviation(PAID_DAY),
        "MIN_DAYS_ENTRY_PAYMENT": f"min({PAID_DAY})",
        "MAX_DAYS_ENTRY_PAYMENT": f"max({PAID_DAY})",
        "MEAN_DAYS_INSTALMENT": mean(DUE_DAY),
        "MIN_DAYS_INSTALMENT": f"min({DUE_DAY})",
        "MAX_DAYS_INSTALMENT": f"max({DUE_DAY})",
        "TIME_SINCE_LAST_PAYMENT": f"abs(max({PAID_DAY}))",
        "ABS_MEAN_PAYMENT_DELAY": f"abs({mean(PAID_DAY)} - {mean(DUE_DAY)})",
        "MEAN_PAYMENT_DELAY": mean("PAYMENT_DELAY"),
        "STD_PAYMENT_DELAY": deviation("PAYMENT_DELAY"),
        "NUM_LATE_PAYMENTS": int_total("LATE_PAYMENT"),
        "LATE_PAYMENT_RATIO": mean("LATE_PAYMENT"),
    },
)


def with_row_flags(df: DataFrame) -> DataFrame:
    """Per payment: paid/due ratio, missed and late flags, days of delay."""
    paid_ratio = ratio(PAID, DUE)
    if isinstance(df.schema[PAID].dataType, T.DecimalType):
        paid_ratio = f"CAST({paid_ratio} AS DECIMAL(18,8))"  # decimal in, decimal out
    return df.withColumns(
        {
            "PAYMENT_RATIO": F.expr(paid_ratio),
            "MISSED_PAYMENT": F.expr(f"coalesce(CAST({PAID} = 0 AS BIGINT), 0L)"),
            "LATE_PAYMENT": F.expr(f"coalesce(CAST({PAID_DAY} > {DUE_DAY} AS BIGINT), 0L)"),
            "PAYMENT_DELAY": F.expr(f"{PAID_DAY} - {DUE_DAY}"),
        }
    )


def fill_payment_ratios(df: DataFrame) -> DataFrame:
    """A payment ratio that cannot be computed counts as fully paid (1)."""
    names = [c for c in df.columns if "PAYMENT_RATIO" in c]
    return df.fillna(1.0, subset=names) if names else df


def features(df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False) -> DataFrame:
    """Engineered columns and the statistics of the four row flags."""
    keys, rows = list(keys), with_row_flags(df)
    flags = rows.select(*ROW_FLAGS)
    return fill_payment_ratios(grouped(rows, keys, {**stats_of(flags, keys, PREFIX), **MEASURES}))


def block(
    df: DataFrame, keys=(CUSTOMER,), closed_labels: bool = False, compat_names: bool = False
) -> DataFrame:
    """``compat_names`` repeats the raw statistics under ``_x`` and ``_y`` names."""
    keys, rows = list(keys), with_row_flags(df)
    out = fill_payment_ratios(grouped(rows, keys, {**stats_of(rows, keys, PREFIX), **MEASURES}))
    if not compat_names:
        return out
    raw = {
        f"{PREFIX}_agg_{name}_{stat}"
        for name in numeric_columns(df, exclude=(*IDENTIFIERS, *keys))
        for stat in ("mean", "sum", "max", "min")
    }
    columns = []
    for name in out.columns:
        if name in raw:
            columns += [F.col(name).alias(f"{name}_x"), F.col(name).alias(f"{name}_y")]
        elif name == f"{PREFIX}_ABS_MEAN_PAYMENT_DELAY":
            columns.append(F.col(name).alias(f"{PREFIX}_MEAN_PAYMENT_DELAY_x"))
        elif name == f"{PREFIX}_MEAN_PAYMENT_DELAY":
            columns.append(F.col(name).alias(f"{name}_y"))
        else:
            columns.append(F.col(name))
    return out.select(*columns)
