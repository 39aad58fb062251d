"""Queries over the feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.operators import sketches
from loanloom.operators.blocks import (
    card_activity,
    cash_pos,
    credit_summary,
    credit_timeline,
    installments,
    prior_loans,
)
from loanloom.operators.blocks.generic import categorical_modes, numeric_aggregates
from loanloom.operators.grouped import with_keys
from loanloom.plans.wide import wide_features
from loanloom.queries.common import (
    LOOSE,
    LOOSE_TIMELINE,
    as_double,
    single,
    table,
    tables,
)
from loanloom.schemas import CUSTOMER, RECORD

PREFIXES = {
    "credit_summary": "credit_summary",
    "credit_timeline": "credit_timeline",
    "card_activity": "card_activity",
    "cash_pos_records": "cash_pos",
    "installment_records": "installments",
    "prior_loan_history": "prior_loan",
}
FEATURES = {
    "credit_summary_features": (credit_summary, "credit_summary"),
    "credit_timeline_features": (credit_timeline, "credit_timeline"),
    "card_activity_features": (card_activity, "card_activity"),
    "cash_pos_features": (cash_pos, "cash_pos_records"),
    "installment_features": (installments, "installment_records"),
    "prior_loan_features": (prior_loans, "prior_loan_history"),
}


def _keys(name: str):
    return (RECORD,) if name == "credit_timeline" else (CUSTOMER,)


def _features(module, name):
    return lambda spark, sf: single(module.features(table(spark, sf, name)), LOOSE)


def _numeric(name):
    return lambda spark, sf: numeric_aggregates(
        table(spark, sf, name), PREFIXES[name], _keys(name)
    )


def _modes(name):
    return lambda spark, sf: categorical_modes(table(spark, sf, name), PREFIXES[name], _keys(name))


def card_last_n_avg(spark, sf):
    return card_activity.last_months(table(spark, sf, "card_activity"))


def installment_row_flags(spark, sf):
    rows = installments.with_row_flags(table(spark, sf, "installment_records"))
    return as_double(
        rows.select(
            "CUSTOMER_ID", "PRIOR_LOAN_ID", "INSTALLMENT_SEQUENCE_NUMBER", *installments.ROW_FLAGS
        )
    )


def loan_age_group(spark, sf):
    rows = cash_pos.with_age_group(table(spark, sf, "cash_pos_records"))
    return rows.select("CUSTOMER_ID", "PRIOR_LOAN_ID", "TIME_SINCE_ENTRY", "LOAN_AGE_GROUP")


def pos_loans_by_sketch(spark, sf):
    """Loans of every customer, merged from the sketches of each month."""
    rows = table(spark, sf, "cash_pos_records")
    monthly = sketches.pos_loans(rows, "TIME_SINCE_ENTRY")
    return sketches.distinct_counts(monthly, name="NUM_POS_LOANS")


def customers_by_month(spark, sf):
    """Customers with point-of-sale loans by month: large groups, within five per cent of the exact count."""
    rows = table(spark, sf, "cash_pos_records")
    month = ("TIME_SINCE_ENTRY",)
    found = sketches.distinct_counts(
        sketches.distinct_sketches(rows, "CUSTOMER_ID", month), month, "approximate"
    )
    exact = with_keys(rows.select(*month, "CUSTOMER_ID"), list(month)).distinct().groupBy(*month)
    both = exact.agg(F.count("CUSTOMER_ID").alias("customers")).join(found, list(month))
    near = F.abs(F.col("approximate") - F.col("customers")) <= 0.05 * F.col("customers")
    return both.select(*month, "customers", near.alias("within_bound"))


def decision_bin(spark, sf):
    rows = prior_loans.with_decision_bin(table(spark, sf, "prior_loan_history"))
    return rows.select("CUSTOMER_ID", "PRIOR_LOAN_ID", prior_loans.DECISION, prior_loans.BIN)


def max_overdue_status(spark, sf):
    return credit_timeline.max_overdue_status(table(spark, sf, "credit_timeline"))


def record_customer_map(spark, sf):
    return credit_timeline.record_customer_map(table(spark, sf, "credit_summary"))


def _records(spark, sf):
    t = tables(spark, sf, ["credit_timeline", "credit_summary"])
    records = credit_timeline.per_record(t["credit_timeline"])
    return records, credit_timeline.record_customer_map(t["credit_summary"])


def timeline_mapping(spark, sf):
    return credit_timeline.map_to_customers(*_records(spark, sf))


def timeline_unmapped(spark, sf):
    report = credit_timeline.unmapped_report(*_records(spark, sf))
    stats = ("mean", "std", "q25", "q50", "q75")
    return report.select(
        *[F.round(c, 6).alias(c) if c in stats else F.col(c) for c in report.columns]
    )


def timeline_final(spark, sf):
    t = tables(spark, sf, ["credit_timeline", "credit_summary"])
    final = credit_timeline.block(t["credit_timeline"], t["credit_summary"])
    return single(final, LOOSE_TIMELINE)


def wide(spark, sf):
    """All features; the adapter labels lie inside their domains by construction."""
    out = wide_features(tables(spark, sf), closed_labels=True, one_by_one=True)
    return as_double(single(out, LOOSE + LOOSE_TIMELINE))


def wide_features_compat(spark, sf):
    """All features under doubled and lambda names."""
    out = wide_features(tables(spark, sf), closed_labels=True, compat_names=True, one_by_one=True)
    return as_double(single(out, LOOSE + LOOSE_TIMELINE))


QUERIES = {
    **{name: _features(module, source) for name, (module, source) in FEATURES.items()},
    **{f"numeric_agg_{name}": _numeric(name) for name in PREFIXES},
    **{
        f"categorical_mode_{name}": _modes(name)
        for name in PREFIXES
        if name != "installment_records"
    },
    "card_last_n_avg": card_last_n_avg,
    "installment_row_flags": installment_row_flags,
    "loan_age_group": loan_age_group,
    "pos_loans_by_sketch": pos_loans_by_sketch,
    "customers_by_month": customers_by_month,
    "decision_bin": decision_bin,
    "max_overdue_status": max_overdue_status,
    "record_customer_map": record_customer_map,
    "timeline_mapping": timeline_mapping,
    "timeline_unmapped": timeline_unmapped,
    "timeline_final": timeline_final,
    "wide_features": wide,
    "wide_features_compat": wide_features_compat,
}
