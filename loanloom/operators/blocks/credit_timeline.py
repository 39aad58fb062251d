"""Monthly history of credit records, rolled up per record and then per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.aggregates import (
    int_total,
    mean,
    numeric_columns,
    prefixed,
    quoted,
    share,
    text_columns,
    total,
)
from loanloom.operators.blocks.generic import IDENTIFIERS, modes_of, stats_of
from loanloom.operators.grouped import grouped, with_keys
from loanloom.operators.quantiles import describe
from loanloom.operators.skew import join_unique
from loanloom.schemas import CUSTOMER, LABELS, RECORD, UNKNOWN, is_fractional

PREFIX = "credit_timeline"
MONTH = "TIME_SINCE_ENTRY"
ON_TIME, DELAYED, DEFAULTED = (quoted(label) for label in LABELS["ACCOUNT_STATUS"])
IS_ON_TIME, IS_DELAYED, IS_DEFAULTED = (
    f"ACCOUNT_STATUS = {label}" for label in (ON_TIME, DELAYED, DEFAULTED)
)
OVERDUE = f"count_if(ACCOUNT_STATUS IN ({DELAYED}, {DEFAULTED}))"
# Worst overdue status of the group; 'On Time' when nothing was overdue.
WORST = (
    f"CASE WHEN count_if({IS_DEFAULTED}) > 0 THEN {DEFAULTED} "
    f"WHEN count_if({IS_DELAYED}) > 0 THEN {DELAYED} ELSE {ON_TIME} END"
)

MEASURES = prefixed(
    PREFIX,
    {
        "NUM_MONTHS": f"count({MONTH})",
        "NUM_CLOSED_MONTHS": f"count_if({IS_DEFAULTED})",
        "NUM_ACTIVE_MONTHS": f"count_if({IS_ON_TIME})",
        "TOTAL_OVERDUE_MONTHS": OVERDUE,
        "OLDEST_RECORD": f"min({MONTH})",
        "MOST_RECENT_RECORD": f"max({MONTH})",
        "CREDIT_HISTORY_LENGTH": f"max({MONTH}) - min({MONTH})",
        "RECENT_OVERDUE_MONTHS": OVERDUE,
        "MAX_OVERDUE_STATUS": WORST,
        "PERCENT_CLOSED": share(IS_DEFAULTED),
        "PERCENT_ACTIVE": share(IS_ON_TIME),
    },
)

# Labels that can appear in the record-level result.
RECORD_LABELS = {
    f"{PREFIX}_agg_ACCOUNT_STATUS_most_frequent": [*LABELS["ACCOUNT_STATUS"], UNKNOWN],
    f"{PREFIX}_MOST_COMMON_STATUS": [*LABELS["ACCOUNT_STATUS"], UNKNOWN],
    f"{PREFIX}_MAX_OVERDUE_STATUS": LABELS["ACCOUNT_STATUS"],
}


MODES = {f"{PREFIX}_MOST_COMMON_STATUS": "ACCOUNT_STATUS"}


def record_keys(keys) -> list[str]:
    return [*[k for k in keys if k != CUSTOMER], RECORD]


def features(df: DataFrame, keys=(RECORD,), closed_labels: bool = False) -> DataFrame:
    """Engineered columns per credit record."""
    return grouped(df, list(keys), MEASURES, MODES, closed_labels=closed_labels)


def max_overdue_status(df: DataFrame, keys=(RECORD,)) -> DataFrame:
    return grouped(df, list(keys), {f"{PREFIX}_MAX_OVERDUE_STATUS": WORST})


def per_record(df: DataFrame, keys=(RECORD,), closed_labels: bool = False) -> DataFrame:
    """Generic aggregates and engineered columns per credit record."""
    keys = list(keys)
    return grouped(
        df,
        keys,
        {**stats_of(df, keys, PREFIX), **MEASURES},
        {**modes_of(df, keys, PREFIX), **MODES},
        closed_labels=closed_labels,
    )


def record_customer_map(summary: DataFrame, keys=(CUSTOMER,)) -> DataFrame:
    """Distinct (record, customer) pairs. Duplicates merge map-side, so a pair
    repeated very often is one row per task before the shuffle."""
    names = [*record_keys(keys), CUSTOMER]
    return with_keys(summary.select(*names), names).distinct()


def map_to_customers(records: DataFrame, mapping: DataFrame, keys=(CUSTOMER,)) -> DataFrame:
    """Attach the customer to each record; records without one drop out, a record
    of two customers counts for both. Very many customers may share a record, such as
    a placeholder id; within a request they do not."""
    on = record_keys(keys)
    if on == [RECORD]:
        joined = join_unique(mapping, records, on, "inner")
    else:
        joined = mapping.join(records, on)
    return joined.select(*records.columns, *[c for c in mapping.columns if c not in on])


def unmapped_report(records: DataFrame, mapping: DataFrame, keys=(CUSTOMER,)) -> DataFrame:
    """Describe the mean record age of mapped and of unmapped records."""
    on = record_keys(keys)
    age = F.col(f"{PREFIX}_agg_{MONTH}_mean").alias("value")
    # A record counts once for each of its customers, as a weight: it is never repeated.
    times = mapping.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    flagged = records.join(times, on, "left").select(
        F.when(F.col("n").isNull(), "unmapped").otherwise("mapped").alias("records"),
        age,
        F.coalesce("n", F.lit(1)).alias("times"),
    )
    return describe(flagged, "records", "value", weight="times")


def per_customer(
    mapped: DataFrame,
    keys=(CUSTOMER,),
    closed_labels: bool = False,
    compat_names: bool = False,
) -> DataFrame:
    """min, max, mean and sum of every record-level number, mode of every label."""
    keys = list(keys)
    schema, measures = mapped.schema, {}
    for name in numeric_columns(mapped, exclude=(*IDENTIFIERS, *keys)):
        summed = total(name) if is_fractional(schema[name].dataType) else int_total(name)
        measures |= {
            f"{name}_min": f"min({name})",
            f"{name}_max": f"max({name})",
            f"{name}_mean": mean(name),
            f"{name}_sum": summed,
        }
    suffix = "<lambda>" if compat_names else "most_frequent"
    modes = {f"{n}_{suffix}": n for n in text_columns(mapped, exclude=(*IDENTIFIERS, *keys))}
    return grouped(
        mapped, keys, measures, modes, labels=RECORD_LABELS, closed_labels=closed_labels
    )


def block(
    timeline: DataFrame,
    summary: DataFrame | None,
    keys=(CUSTOMER,),
    closed_labels: bool = False,
    compat_names: bool = False,
) -> DataFrame:
    """History per customer: record level, mapping through the summary, customer level.

    Without a summary the rows of the timeline carry the keys themselves.
    """
    records = per_record(timeline, record_keys(keys), closed_labels)
    if summary is None:
        return per_customer(records, keys, closed_labels, compat_names)
    mapping = record_customer_map(summary, keys)
    mapped = map_to_customers(records, mapping, keys)
    return per_customer(mapped, keys, closed_labels, compat_names)
