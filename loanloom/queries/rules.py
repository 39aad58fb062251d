"""Queries over rules, labels, cleaning and alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loanloom.functions.aggregates import numeric_columns
from loanloom.functions.cleaning import to_bigint, typed_amount, with_clean_id
from loanloom.operators import alignment, labels, quality, risk
from loanloom.operators.alignment import FeatureSchema
from loanloom.operators.explanations import explanation_rows, top_explanations
from loanloom.operators.quantiles import describe_columns
from loanloom.plans import stored
from loanloom.plans.scoring import rule_explanations
from loanloom.plans.training import category_indexer
from loanloom.plans.wide import feature_blocks
from loanloom.queries.common import as_double, table, tables
from loanloom.queries.features import wide
from loanloom.schemas import CUSTOMER, LABELS, LOAN, MISSING, RULE_WEIGHTS
from loanloom.session import configure
from loanloom.sources.adapters import run_sql
from loanloom.sources.request_views import RAW_PROFILE
from loanloom.sources.shared import shared_folder, written


def _profile(spark, sf):
    return as_double(table(spark, sf, "customer_profile"))


def _scored(spark, sf):
    return risk.with_decision(risk.rule_score(_profile(spark, sf)))


def rule_score(spark, sf):
    return risk.rule_score(_profile(spark, sf)).select(
        CUSTOMER, *RULE_WEIGHTS, "default_probability"
    )


def frozen_rule_score(spark, sf):
    """All profiles scored by the rule as fitted on one type of loan, stored and read back."""
    profile = _profile(spark, sf)
    path = f"{shared_folder(spark)}/rule-{uuid.uuid4().hex}"
    stored.write_rule(spark, stored.fit_rule(profile.filter("LOAN_CONTRACT_TYPE = 'Loan Type A'")), path)
    scored = stored.read_rule(spark, path)(profile)
    return scored.select(CUSTOMER, *RULE_WEIGHTS, "default_probability")


def prediction_record(spark, sf):
    return _scored(spark, sf).select(
        CUSTOMER,
        "prediction",
        "default_probability",
        "formatted_probability",
        "risk_band",
        "score_class",
    )


def top3_explanations(spark, sf):
    rows = rule_explanations(_scored(spark, sf))
    return explanation_rows(rows, CUSTOMER).select(
        CUSTOMER, "pos", "e.feature", "e.value", F.round("e.impact", 9).alias("impact"),
        "e.direction",
    )


def dti_check(spark, sf):
    return risk.with_dti(_profile(spark, sf)).select(
        CUSTOMER, F.round("dti_ratio", 9).alias("dti_ratio"), "dti_accepted", "dti_warning"
    )


def dti_cap(spark, sf):
    profile = _profile(spark, sf)
    capped = risk.capped_loan(*[F.col(n) for n in (risk.INCOME, risk.LOAN, risk.TERM)])
    return profile.select(CUSTOMER, capped.alias("capped_loan"))


def value_counts_top(spark, sf):
    return quality.value_counts(_profile(spark, sf), "EXTERNAL_CREDIT_SCORE")


def target_rate_by_flag(spark, sf):
    filled = risk.filled_inputs(_profile(spark, sf))
    return labels.rate_by(filled, (F.col(risk.EXTERNAL) == 0).cast("int"), "ext_zero")


def class_weights(spark, sf):
    return labels.class_weights(_profile(spark, sf))


def stratified_split(spark, sf):
    return labels.stratified_split(_profile(spark, sf).select(CUSTOMER, labels.TARGET))


def classification_report(spark, sf):
    return labels.classification_report(_scored(spark, sf), "prediction")


def roc_auc(spark, sf):
    scored = _scored(spark, sf)
    area = labels.roc_auc(scored, "default_probability")
    return scored.agg(
        F.sum(labels.TARGET).alias("n_positive"),
        F.count_if(F.col(labels.TARGET) == 0).alias("n_negative"),
    ).withColumn("auc", F.round(F.lit(area), 6))


def _raw(spark, sf):
    configure(spark)
    return run_sql(spark, sf, RAW_PROFILE)


def clean_ids(spark, sf):
    raw = _raw(spark, sf)
    counted = raw.withColumn("children", to_bigint(raw, "NUM_CHILDREN"))
    return with_clean_id(counted).select("ROW_ID", CUSTOMER, "id_state", "children")


def clean_amounts(spark, sf):
    amount = typed_amount(F.col("TYPED_AMOUNT"), F.col("OLD_AMOUNT"))
    return _raw(spark, sf).select("ROW_ID", amount.alias("amount"))


RAW_SCHEMA = FeatureSchema(
    ["ROW_ID", "NUM_CHILDREN", "MONTHLY_INCOME", "HOUSING_TYPE"],
    {
        "ROW_ID": "int64",
        "NUM_CHILDREN": "Int64",
        "MONTHLY_INCOME": "float64",
        "HOUSING_TYPE": "category",
    },
    {"HOUSING_TYPE": LABELS["HOUSING_TYPE"]},
)
ALIGNED = ["LOAN_TERM_MONTHS", "BRAND_NEW_FEATURE", "OCCUPATION_TYPE", CUSTOMER]


def align_schema(spark, sf):
    return alignment.align(_profile(spark, sf), ALIGNED)


def _typed(spark, sf):
    raw = alignment.align(_raw(spark, sf), RAW_SCHEMA.features)
    return alignment.enforce_types(raw, RAW_SCHEMA)


def enforce_types(spark, sf):
    return _typed(spark, sf)


def fill_scoring(spark, sf):
    return alignment.fill_scoring(_typed(spark, sf))


def fill_training(spark, sf):
    return alignment.fill_training(_typed(spark, sf))


def drop_all_null(spark, sf):
    """The wide table, written once for its two passes, and a column that no row fills."""
    empty = F.when(F.col(CUSTOMER) < 0, F.lit("x"))
    return alignment.drop_all_null(written(wide(spark, sf).withColumn("NEVER_FILLED", empty), "wide"))


def union_batches(spark, sf):
    profile = _profile(spark, sf)
    first = F.col("LOAN_CONTRACT_TYPE") == LABELS["LOAN_CONTRACT_TYPE"][0]
    some = profile.filter(first).select(CUSTOMER, risk.OCCUPATION)
    others = profile.filter(~first).select(CUSTOMER, risk.EXTERNAL)
    return alignment.union_batches([some, others])


CATEGORIES = ["OCCUPATION_TYPE", "LOAN_CONTRACT_TYPE", "HOUSING_TYPE"]


def category_domains(spark, sf):
    domains = alignment.category_domains(_profile(spark, sf), CATEGORIES)
    return domains.select("feature", F.array_join("categories", "|").alias("categories"))


def label_codes(spark, sf):
    """Every label of the profile's categories and of the prior loans' texts with its dense code."""
    profile = alignment.label_codes(_profile(spark, sf), CATEGORIES)
    prior = table(spark, sf, "prior_loan_history")
    names = [f.name for f in prior.schema if f.dataType.typeName() == "string"]
    return profile.unionByName(alignment.label_codes(prior, names))


def category_codes(spark, sf):
    filled = _profile(spark, sf).select(CUSTOMER, *CATEGORIES).fillna(MISSING)
    coded = category_indexer(CATEGORIES).fit(filled).transform(filled)
    return coded.select(
        CUSTOMER, *[F.col(f"{n}__code").cast("bigint").alias(f"{n}__code") for n in CATEGORIES]
    )


def quality_report(spark, sf):
    """Every column of every feature block, one block's shuffle files on disk at a time."""
    blocks = feature_blocks(tables(spark, sf), closed_labels=True)
    reports = [written(quality.quality_report(block, name), "report") for name, block in blocks.items()]
    return alignment.union_batches(reports)


def block_coverage(spark, sf):
    blocks = feature_blocks(tables(spark, sf), closed_labels=True)
    return quality.block_coverage({"customer_profile": _profile(spark, sf), **blocks})


def _column_profile(spark, sf):
    parts = [quality.column_profile(df, name) for name, df in tables(spark, sf).items()]
    return alignment.union_batches(parts)


def _flat(profile):
    return profile.select(
        "table",
        "column",
        "dtype",
        "min",
        "max",
        F.round("mean", 6).alias("mean"),
        F.round("std", 5).alias("std"),
        F.array_join("categories", "|").alias("categories"),
    )


def column_profile(spark, sf):
    return _flat(_column_profile(spark, sf))


def profile_overrides(spark, sf):
    return _flat(quality.with_overrides(_column_profile(spark, sf)))


# Given weights of a linear score over columns of the profile.
LINEAR_WEIGHTS = {
    "LOAN_AMOUNT": 0.00002,
    "MONTHLY_INCOME": -0.0001,
    "LOAN_TERM_MONTHS": 0.01,
    "NUM_CHILDREN": 0.003,
    "AGE_DAYS": -0.002,
    "EMPLOYMENT_DURATION_DAYS": 0.00005,
    "EXTERNAL_CREDIT_SCORE": -1.5,
}


def linear_attribution(spark, sf):
    """The three columns that move a linear score of given weights most, by distance from their means."""
    shown = {n: (n, n) for n in LINEAR_WEIGHTS}
    rows = top_explanations(_profile(spark, sf), LINEAR_WEIGHTS, shown)
    return explanation_rows(rows, CUSTOMER).select(
        CUSTOMER, "pos", "e.feature", "e.value", F.round("e.impact", 9).alias("impact"),
        "e.direction",
    )


def numeric_summary(spark, sf):
    """Every number of the prior loans but the identifiers."""
    prior = table(spark, sf, "prior_loan_history")
    names = numeric_columns(prior, exclude=(CUSTOMER, LOAN))
    out = describe_columns(prior, names)
    loose = ("mean", "std", "q25", "q50", "q75")
    return out.select(*[F.round(c, 4).alias(c) if c in loose else F.col(c) for c in out.columns])


QUERIES = {
    f.__name__: f
    for f in (
        rule_score,
        frozen_rule_score,
        prediction_record,
        top3_explanations,
        dti_check,
        dti_cap,
        value_counts_top,
        target_rate_by_flag,
        class_weights,
        stratified_split,
        classification_report,
        roc_auc,
        clean_ids,
        clean_amounts,
        align_schema,
        enforce_types,
        fill_scoring,
        fill_training,
        drop_all_null,
        union_batches,
        category_domains,
        category_codes,
        label_codes,
        quality_report,
        block_coverage,
        column_profile,
        profile_overrides,
        numeric_summary,
        linear_attribution,
    )
}
