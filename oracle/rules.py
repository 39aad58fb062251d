"""Oracle SQL of rules, labels, cleaning, alignment and reports."""

from __future__ import annotations

from loanloom.schemas import RANGE_OVERRIDES, table_schema
from loanloom.sources.adapters import FILLED as FILLED_COLUMNS
from loanloom.sources.request_views import RAW_PROFILE
from oracle.blocks import WIDE, WIDE_NAMES, with_blocks
from oracle.build import duck, with_views

P = (
    "(SELECT * REPLACE (CAST(MONTHLY_INCOME AS DOUBLE) AS MONTHLY_INCOME, "
    "CAST(LOAN_AMOUNT AS DOUBLE) AS LOAN_AMOUNT) FROM v_customer_profile)"
)
FILLED = f"""(SELECT CUSTOMER_ID, TARGET, coalesce(LOAN_AMOUNT, 0) AS LOAN_AMOUNT,
 CAST(coalesce(EMPLOYMENT_DURATION_DAYS, 0) AS DOUBLE) AS EMPLOYMENT_DURATION_DAYS,
 coalesce(EXTERNAL_CREDIT_SCORE, 0) AS EXTERNAL_CREDIT_SCORE,
 CAST(coalesce(LOAN_TERM_MONTHS, 0) AS DOUBLE) AS LOAN_TERM_MONTHS,
 coalesce(OCCUPATION_TYPE, 'Missing') AS OCCUPATION_TYPE FROM {P})"""
TERMS = f"""(SELECT f.*,
 CAST(LOAN_AMOUNT > m_loan AS DOUBLE) AS big_loan,
 CAST(EMPLOYMENT_DURATION_DAYS < m_days AS DOUBLE) AS long_employed,
 1e0 - EXTERNAL_CREDIT_SCORE AS bad_external_score,
 CASE OCCUPATION_TYPE WHEN 'Job A' THEN 2e0 WHEN 'Job B' THEN 1e0 WHEN 'Job C' THEN 0e0
  WHEN 'Job D' THEN -1e0 WHEN 'Job E' THEN -2e0 ELSE 0e0 END AS occupation_risk,
 CAST(LOAN_TERM_MONTHS > m_term AS DOUBLE) AS long_term
 FROM {FILLED} f, (SELECT median(LOAN_AMOUNT) AS m_loan,
  median(EMPLOYMENT_DURATION_DAYS) AS m_days, median(LOAN_TERM_MONTHS) AS m_term FROM {FILLED}))"""
SCORED = f"""(SELECT *, greatest(1e-2, least(95e-2, 5e-2 + 20e-2 * big_loan + 15e-2 * long_employed
 + 50e-2 * bad_external_score + 35e-2 * occupation_risk + 10e-2 * long_term))
 AS default_probability FROM {TERMS})"""
DECIDED = f"""(SELECT *, CAST(default_probability > 5e-1 AS INTEGER) AS prediction,
 printf('%.2f%%', default_probability * 100) AS formatted_probability FROM {SCORED})"""

# The rule with medians frozen on the loans of one type.
FITTED = FILLED.replace(
    "FROM v_customer_profile)", "FROM v_customer_profile WHERE LOAN_CONTRACT_TYPE = 'Loan Type A')"
)
FROZEN = SCORED.replace(TERMS, FITTED.join(TERMS.rsplit(FILLED, 1)))

WEIGHTS = {
    "big_loan": ("20e-2", "LOAN_AMOUNT"),
    "long_employed": ("15e-2", "EMPLOYMENT_DURATION_DAYS"),
    "bad_external_score": ("50e-2", "EXTERNAL_CREDIT_SCORE"),
    "occupation_risk": ("35e-2", "OCCUPATION_TYPE"),
    "long_term": ("10e-2", "LOAN_TERM_MONTHS"),
}
LINEAR = {
    "LOAN_AMOUNT": "2e-5",
    "MONTHLY_INCOME": "-1e-4",
    "LOAN_TERM_MONTHS": "1e-2",
    "NUM_CHILDREN": "3e-3",
    "AGE_DAYS": "-2e-3",
    "EMPLOYMENT_DURATION_DAYS": "5e-5",
    "EXTERNAL_CREDIT_SCORE": "-15e-1",
}


def top3(terms: str, weights: dict[str, tuple[str, str]]) -> str:
    """The three largest of weight times distance from the mean; a NULL term is at the mean."""
    means = ", ".join(
        f"CAST(sum(CAST({t} AS DECIMAL(28,8))) AS DOUBLE) / count({t}) AS m_{t}" for t in weights
    )
    impacts = " UNION ALL ".join(
        f"SELECT CUSTOMER_ID, '{source}' AS feature, CAST({source} AS VARCHAR) AS value, "
        f"{w} * (coalesce(CAST({t} AS DOUBLE), m_{t}) - m_{t}) AS impact FROM terms, centers"
        for t, (w, source) in weights.items()
    )
    return f"""
SELECT CUSTOMER_ID, pos, feature, value, round(impact, 9) AS impact,
 CASE WHEN impact > 0 THEN 'increased risk' ELSE 'reduced risk' END AS direction
FROM (WITH terms AS (SELECT * FROM {terms}), centers AS (SELECT {means} FROM terms)
 SELECT *, CAST(row_number() OVER (PARTITION BY CUSTOMER_ID ORDER BY abs(impact) DESC, feature)
  - 1 AS INTEGER) AS pos FROM ({impacts}))
WHERE pos < 3"""


DTI = f"""(SELECT *, CASE WHEN MONTHLY_INCOME > 0 AND LOAN_AMOUNT > 0 AND LOAN_TERM_MONTHS > 0
 THEN LOAN_AMOUNT / CAST(LOAN_TERM_MONTHS AS DOUBLE) / MONTHLY_INCOME END AS dti FROM {P})"""
MOST = "MONTHLY_INCOME * CAST(LOAN_TERM_MONTHS AS DOUBLE) * 3e-1"

SPLIT_HASH = "(((CUSTOMER_ID % 10007 + 10007) % 10007) * 7919 + 42) % 10007"

REPORT = f"""
WITH c AS (SELECT count(*) FILTER (WHERE prediction = 0 AND TARGET = 0) AS tn,
  count(*) FILTER (WHERE prediction = 1 AND TARGET = 0) AS fp,
  count(*) FILTER (WHERE prediction = 0 AND TARGET = 1) AS fn,
  count(*) FILTER (WHERE prediction = 1 AND TARGET = 1) AS tp FROM {DECIDED}),
s AS (SELECT '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0e0) AS p,
   coalesce(tn / nullif(tn + fp, 0), 0e0) AS r, tn + fp AS support FROM c
  UNION ALL SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0e0),
   coalesce(tp / nullif(tp + fn, 0), 0e0), tp + fn FROM c),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0e0) AS f1 FROM s),
a AS (SELECT max(CASE WHEN label = '0' THEN p END) AS p0, max(CASE WHEN label = '1' THEN p END) AS p1,
  max(CASE WHEN label = '0' THEN r END) AS r0, max(CASE WHEN label = '1' THEN r END) AS r1,
  max(CASE WHEN label = '0' THEN f1 END) AS f0, max(CASE WHEN label = '1' THEN f1 END) AS f1,
  max(CASE WHEN label = '0' THEN support END) AS n0,
  max(CASE WHEN label = '1' THEN support END) AS n1 FROM f)
SELECT label, p AS precision, r AS recall, f1 AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM c
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n0 + n1 FROM a
UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / (n0 + n1), (r0 * n0 + r1 * n1) / (n0 + n1),
 (f0 * n0 + f1 * n1) / (n0 + n1), n0 + n1 FROM a"""

AUC = f"""
WITH s AS (SELECT default_probability AS p, sum(TARGET) AS pos,
  count(*) - sum(TARGET) AS neg FROM {SCORED} GROUP BY 1),
r AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM s)
SELECT CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
 round(CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / 2 / CAST(sum(pos) * sum(neg) AS DOUBLE), 6)
 AS auc FROM r"""

NUM = "TRY_CAST({x} AS DOUBLE)"
ID = NUM.format(x="CUSTOMER_ID")
RAW = f"({duck(RAW_PROFILE)})"
INT_CHILDREN = "CAST(round_even(TRY_CAST(NUM_CHILDREN AS DOUBLE), 0) AS BIGINT)"
TYPED = f"""SELECT ROW_ID, {INT_CHILDREN} AS NUM_CHILDREN,
 TRY_CAST(MONTHLY_INCOME AS DOUBLE) AS MONTHLY_INCOME,
 CASE WHEN HOUSING_TYPE IN ('Housing A', 'Housing B', 'Housing C', 'Other') THEN HOUSING_TYPE END
 AS HOUSING_TYPE FROM {RAW}"""

CATEGORIES = ["OCCUPATION_TYPE", "LOAN_CONTRACT_TYPE", "HOUSING_TYPE"]
DOMAINS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS categories FROM {P}"
    for c in CATEGORIES
)
CODES = ", ".join(
    f"CAST(dense_rank() OVER (ORDER BY coalesce({c}, 'Missing')) - 1 AS BIGINT) AS {c}__code"
    for c in CATEGORIES
)

PRIOR_TEXTS = [f.name for f in table_schema("prior_loan_history") if f.dataType.typeName() == "string"]
LABEL_CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS code "
    f"FROM (SELECT DISTINCT {c} AS label FROM {view} WHERE {c} IS NOT NULL)"
    for view, names in ((P, CATEGORIES), ("v_prior_loan_history", PRIOR_TEXTS)) for c in names
)

BLOCK_OF = {
    "credit_summary": "b_summary",
    "credit_timeline": "b_timeline",
    "cash_pos_records": "b_pos",
    "card_activity": "b_card",
    "prior_loan_history": "b_prior",
    "installment_records": "b_inst",
}


def quality() -> str:
    parts = []
    for name, cte in BLOCK_OF.items():
        parts.append(
            f"SELECT '{name}' AS \"table\", c AS \"column\", n_rows, n_rows - n AS n_null, "
            f"hidden AS n_hidden, inf AS n_inf FROM (UNPIVOT (SELECT "
            f"struct_pack(n := count(COLUMNS(*)), "
            f"h := count(*) FILTER (WHERE CAST(COLUMNS(*) AS VARCHAR) IN ('', 'nan')), "
            f"i := count(*) FILTER (WHERE CAST(COLUMNS(*) AS VARCHAR) IN ('inf', '-inf'))) "
            f"FROM {cte}) ON COLUMNS(*) INTO NAME c VALUE v), "
            f"LATERAL (SELECT v.n AS n, v.h AS hidden, v.i AS inf), "
            f"(SELECT count(*) AS n_rows FROM {cte})"
        )
    return with_blocks(" UNION ALL ".join(parts), WIDE_NAMES)


def coverage(width: dict[str, int]) -> str:
    parts = [
        "SELECT 'customer_profile' AS stage, count(*) AS n_rows, "
        "count(DISTINCT CUSTOMER_ID) AS n_customers, 50 AS n_columns FROM v_customer_profile"
    ]
    for name, cte in BLOCK_OF.items():
        parts.append(
            f"SELECT '{name}', count(*), count(DISTINCT CUSTOMER_ID), {width[name]} FROM {cte}"
        )
    return with_blocks(" UNION ALL ".join(parts), WIDE_NAMES)


# Columns of each block at the adapter tables' width, key included.
WIDTH = {
    "credit_summary": 56,
    "credit_timeline": 60,
    "cash_pos_records": 36,
    "card_activity": 99,
    "prior_loan_history": 103,
    "installment_records": 62,
}

I, F, S = "int64", "float64", "category"
PROFILE_TYPES = {
    "customer_profile": {
        "CUSTOMER_ID": I, "OCCUPATION_TYPE": S, "LOAN_CONTRACT_TYPE": S, "HOUSING_TYPE": S,
        "MONTHLY_INCOME": F, "LOAN_AMOUNT": F, "LOAN_TERM_MONTHS": I,
        "EMPLOYMENT_DURATION_DAYS": I, "EXTERNAL_CREDIT_SCORE": F, "TARGET": I,
    },
    "credit_summary": {
        "CUSTOMER_ID": I, "CREDIT_RECORD_ID": I, "CREDIT_STATUS": S, "CURRENCY_TYPE": S,
        "NUM_CREDIT_EXTENSIONS": S, "TYPE_OF_CREDIT": S, "DAYS_SINCE_CREDIT_ISSUED": I,
        "DAYS_OVERDUE": I, "DAYS_UNTIL_CREDIT_END": F, "DAYS_UNTIL_ACTUAL_CREDIT_CLOSED": F,
        "TOTAL_CREDIT_AMOUNT": F, "OUTSTANDING_DEBT": F, "CREDIT_LIMIT": F,
        "OVERDUE_BALANCE": F, "DAYS_SINCE_CREDIT_UPDATE": I,
    },
    "credit_timeline": {"CREDIT_RECORD_ID": I, "TIME_SINCE_ENTRY": I, "ACCOUNT_STATUS": S},
    "card_activity": {
        "PRIOR_LOAN_ID": I, "CUSTOMER_ID": I, "TIME_SINCE_ENTRY": I, "CURRENT_CARD_BALANCE": F,
        "CARD_CREDIT_LIMIT": I, "CURRENT_PAYMENT": F, "PRINCIPAL_DUE": F,
        "RECEIVABLE_BALANCE": F, "CONTRACT_STATUS": S, "DAYS_PAST_DUE": I,
        "DAYS_PAST_DUE_90": I,
    },
    "cash_pos_records": {
        "PRIOR_LOAN_ID": I, "CUSTOMER_ID": I, "TIME_SINCE_ENTRY": I, "LOAN_TERM_MONTHS": I,
        "REMAINING_TERM_MONTHS": I, "CONTRACT_STATUS": S, "DAYS_PAST_DUE": I,
        "DAYS_PAST_DUE_90": I,
    },
    "installment_records": {
        "PRIOR_LOAN_ID": I, "CUSTOMER_ID": I, "INSTALLMENT_PLAN_VERSION": I,
        "INSTALLMENT_SEQUENCE_NUMBER": I, "DAYS_UNTIL_DUE": I, "DAYS_BEFORE_ACTUAL_PAYMENT": I,
        "SCHEDULED_PAYMENT_AMOUNT": F, "ACTUAL_PAYMENT_AMOUNT": F,
    },
    "prior_loan_history": {
        "PRIOR_LOAN_ID": I, "CUSTOMER_ID": I, "LOAN_CONTRACT_TYPE": S,
        "REQUESTED_LOAN_AMOUNT": F, "LOAN_AMOUNT": F, "LOAN_PURPOSE_CATEGORY": S,
        "CONTRACT_STATUS": S, "CLIENT_TYPE": S, "DAYS_SINCE_DECISION": I,
        "PLANNED_NUM_PAYMENTS": F, "DAYS_UNTIL_FIRST_PAYMENT": F,
        "DAYS_UNTIL_FINAL_PAYMENT": F, "DAYS_UNTIL_TERMINATION": F,
    },
}


_KINDS = {"bigint": I, "double": F, "string": S}
for _table, _columns in FILLED_COLUMNS.items():
    PROFILE_TYPES[_table] |= {name: _KINDS[kind] for name, kind in _columns.items()}


def profile(overrides: bool) -> str:
    parts = []
    for table, columns in PROFILE_TYPES.items():
        for c, kind in columns.items():
            head = f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", '{kind}' AS dtype, "
            if kind == S:
                parts.append(
                    head + "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, "
                    f"NULL::DOUBLE AS std, string_agg(DISTINCT {c}, '|' ORDER BY {c}) "
                    f"AS categories FROM v_{table}"
                )
            else:
                exact = f"CAST({c} AS DECIMAL(28,4))"
                parts.append(
                    head + f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                    f"round(CAST(sum({exact}) AS DOUBLE) / count({c}), 6) AS mean, "
                    f"round(stddev_samp(CAST({c} AS DOUBLE)), 5) AS std, "
                    f"NULL::VARCHAR AS categories FROM v_{table}"
                )
    union = " UNION ALL ".join(parts)
    if not overrides:
        return with_views(union)
    values = ", ".join(
        f"('{n}', {', '.join(f'{float(x)}::DOUBLE' for x in v)})" for n, v in RANGE_OVERRIDES.items()
    )
    return with_views(
        "SELECT u.* REPLACE (coalesce(o.a, u.min) AS min, coalesce(o.b, u.max) AS max, "
        "coalesce(o.c, u.mean) AS mean, coalesce(o.d, u.std) AS std) "
        f"FROM ({union}) u LEFT JOIN (VALUES {values}) o(n, a, b, c, d) ON o.n = u.\"column\""
    )


def summary() -> str:
    parts = []
    for c, kind in PROFILE_TYPES["prior_loan_history"].items():
        if kind == S or c in ("CUSTOMER_ID", "PRIOR_LOAN_ID"):
            continue
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", "
            f"round(CAST(sum({c}) AS DOUBLE) / count({c}), 4) AS mean, "
            f"round(stddev_samp({x}), 4) AS std, min({x}) AS min, max({x}) AS max, "
            f"round(quantile_cont({x}, 0.25), 4) AS q25, round(quantile_cont({x}, 0.5), 4) AS q50, "
            f"round(quantile_cont({x}, 0.75), 4) AS q75 FROM v_prior_loan_history"
        )
    return with_views(" UNION ALL ".join(parts))


def oracle() -> dict[str, str]:
    return {
        "rule_score": with_views(
            "SELECT CUSTOMER_ID, big_loan, long_employed, bad_external_score, occupation_risk, "
            f"long_term, default_probability FROM {SCORED}"
        ),
        "frozen_rule_score": with_views(
            "SELECT CUSTOMER_ID, big_loan, long_employed, bad_external_score, occupation_risk, "
            f"long_term, default_probability FROM {FROZEN}"
        ),
        "prediction_record": with_views(
            "SELECT CUSTOMER_ID, prediction, default_probability, formatted_probability, "
            "CASE WHEN prediction = 1 THEN 'High Risk (Default Likely)' "
            "ELSE 'Low Risk (Default Unlikely)' END AS risk_band, "
            "CASE WHEN CAST(replace(formatted_probability, '%', '') AS DOUBLE) > 50 "
            f"THEN 'high-risk' ELSE 'low-risk' END AS score_class FROM {DECIDED}"
        ),
        "top3_explanations": with_views(top3(TERMS, WEIGHTS)),
        "linear_attribution": with_views(top3(P, {t: (w, t) for t, w in LINEAR.items()})),
        "dti_check": with_views(
            "SELECT CUSTOMER_ID, round(dti, 9) AS dti_ratio, "
            "NOT coalesce(dti > 3e-1, false) AS dti_accepted, "
            "CASE WHEN dti > 3e-1 THEN printf('DTI ratio too high (%.1f%%). "
            f"Please choose a lower loan amount.', dti * 100) ELSE '' END AS dti_warning FROM {DTI}"
        ),
        "dti_cap": with_views(
            "SELECT CUSTOMER_ID, CASE WHEN MONTHLY_INCOME > 0 AND LOAN_TERM_MONTHS > 0 AND "
            f"LOAN_AMOUNT > {MOST} THEN floor({MOST}) ELSE LOAN_AMOUNT END AS capped_loan FROM {P}"
        ),
        "value_counts_top": with_views(
            f"SELECT EXTERNAL_CREDIT_SCORE, count(*) AS n FROM {P} GROUP BY 1 "
            "ORDER BY n DESC, EXTERNAL_CREDIT_SCORE ASC NULLS LAST LIMIT 5"
        ),
        "target_rate_by_flag": with_views(
            "SELECT CAST(EXTERNAL_CREDIT_SCORE = 0 AS INTEGER) AS ext_zero, "
            "CAST(sum(TARGET) AS DOUBLE) / count(TARGET) AS target_rate, count(*) AS n "
            f"FROM {FILLED} GROUP BY 1"
        ),
        "class_weights": with_views(
            "SELECT TARGET, n, CAST(sum(n) OVER () AS DOUBLE) / (2 * n) AS weight FROM "
            f"(SELECT TARGET, count(*) AS n FROM {P} WHERE TARGET IS NOT NULL GROUP BY 1)"
        ),
        "stratified_split": with_views(
            "SELECT CUSTOMER_ID, TARGET, CASE WHEN rn <= floor(n * 0.25) THEN 'validation' "
            "ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY TARGET "
            f"ORDER BY {SPLIT_HASH}, CUSTOMER_ID) AS rn, count(*) OVER (PARTITION BY TARGET) AS n "
            f"FROM {P})"
        ),
        "classification_report": _nested(REPORT),
        "roc_auc": _nested(AUC),
        "clean_ids": (
            f"SELECT ROW_ID, CASE WHEN {ID} = floor({ID}) THEN CAST({ID} AS BIGINT) END "
            f"AS CUSTOMER_ID, CASE WHEN {ID} IS NULL THEN 'missing' WHEN {ID} = floor({ID}) "
            f"THEN 'ok' ELSE 'quarantined' END AS id_state, {INT_CHILDREN} AS children FROM {RAW}"
        ),
        "clean_amounts": (
            "SELECT ROW_ID, coalesce(CASE WHEN TYPED_AMOUNT = '' THEN 0e0 "
            "ELSE TRY_CAST(replace(TYPED_AMOUNT, ',', '') AS DOUBLE) END, OLD_AMOUNT) AS amount "
            f"FROM {RAW}"
        ),
        "align_schema": with_views(
            "SELECT LOAN_TERM_MONTHS, 0 AS BRAND_NEW_FEATURE, OCCUPATION_TYPE, CUSTOMER_ID "
            f"FROM {P}"
        ),
        "enforce_types": TYPED,
        "fill_scoring": (
            "SELECT * REPLACE (coalesce(HOUSING_TYPE, 'Missing') AS HOUSING_TYPE) "
            f"FROM ({TYPED})"
        ),
        "fill_training": (
            "SELECT ROW_ID, coalesce(NUM_CHILDREN, 0) AS NUM_CHILDREN, "
            "coalesce(MONTHLY_INCOME, 0) AS MONTHLY_INCOME, "
            f"coalesce(HOUSING_TYPE, 'Missing') AS HOUSING_TYPE FROM ({TYPED})"
        ),
        "drop_all_null": with_blocks(WIDE, WIDE_NAMES),
        "union_batches": with_views(
            "SELECT CUSTOMER_ID, CASE WHEN LOAN_CONTRACT_TYPE = 'Loan Type A' THEN OCCUPATION_TYPE END AS "
            "OCCUPATION_TYPE, CASE WHEN LOAN_CONTRACT_TYPE <> 'Loan Type A' THEN EXTERNAL_CREDIT_SCORE END AS "
            f"EXTERNAL_CREDIT_SCORE FROM {P}"
        ),
        "category_domains": with_views(DOMAINS),
        "category_codes": with_views(f"SELECT CUSTOMER_ID, {CODES} FROM {P}"),
        "label_codes": with_views(LABEL_CODES),
        "quality_report": quality(),
        "block_coverage": coverage(WIDTH),
        "column_profile": profile(False),
        "profile_overrides": profile(True),
        "numeric_summary": summary(),
    }


def _nested(query: str) -> str:
    return with_views(f"SELECT * FROM ({query})")
