"""Oracle SQL of the request path."""

from __future__ import annotations

from loanloom.schemas import CHILD_TABLES, table_schema
from loanloom.sources.request_views import (
    BROKEN,
    NO_ID,
    NO_PROFILE,
    OVERRIDES,
    REQUEST_ORDERS,
    child_sql,
    profile_sql,
)
from oracle import blocks as B
from oracle.build import block, duck, mean, stats

KEY = "REQUEST_ID, CUSTOMER_ID"
REASON = (
    f"CASE WHEN {BROKEN} THEN 'unreadable' WHEN {NO_PROFILE} THEN 'no customer_profile' "
    f"WHEN {NO_ID} THEN 'no CUSTOMER_ID' END"
)
ALL_REQUESTS = f"SELECT *, {REASON} AS reason FROM ({duck(REQUEST_ORDERS)})"
PREFIXES = B.PREFIX


def with_requests(query: str, names: list[str], more: str = "") -> str:
    ctes = [
        f"all_requests AS ({ALL_REQUESTS})",
        "requests AS (SELECT * FROM all_requests WHERE reason IS NULL)",
        f"r_profile AS ({profile_sql()})",
        *[f"r_{t} AS ({child_sql(t)})" for t in names],
    ]
    return f"WITH {', '.join(ctes)}{more} {query}"


def _stats(table: str) -> list[str]:
    skip = ("CUSTOMER_ID", "CREDIT_RECORD_ID", "PRIOR_LOAN_ID")
    kinds = {f.name: f.dataType.simpleString() for f in table_schema(table) if f.name not in skip}
    ints = [n for n, k in kinds.items() if k == "bigint"]
    money = [n for n, k in kinds.items() if k == "double"]
    return stats(PREFIXES[table], ints, money)


def _modes(table: str) -> dict[str, str]:
    kinds = {f.name: f.dataType.simpleString() for f in table_schema(table)}
    return {
        f"{PREFIXES[table]}_agg_{n}_most_frequent": n for n, k in kinds.items() if k == "string"
    }


def _last(column: str, n: int) -> str:
    return mean(f"CASE WHEN rn <= {n} THEN {column} END")


CARD = (
    "SELECT f.*, l.* EXCLUDE (REQUEST_ID, CUSTOMER_ID) FROM ("
    + block("r_card_activity", KEY, _stats("card_activity") + B.CARD, _modes("card_activity"))
    + ") f LEFT JOIN (SELECT REQUEST_ID, CUSTOMER_ID, "
    + ", ".join(
        f"{_last(c, n)} AS card_activity_AVG_{name}_LAST_{n}M"
        for name, c in (("BALANCE", "CURRENT_CARD_BALANCE"), ("PAYMENT", "CURRENT_PAYMENT"))
        for n in (6, 12)
    )
    + f" FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY TIME_SINCE_ENTRY DESC, "
    f"PRIOR_LOAN_ID DESC) AS rn FROM r_card_activity) GROUP BY {KEY}) l USING ({KEY})"
)
RECORDS = block(
    "r_credit_timeline",
    "REQUEST_ID, CREDIT_RECORD_ID",
    _stats("credit_timeline") + B.TIMELINE,
    {**_modes("credit_timeline"), **B.TIMELINE_MODES},
)
RATIO = (
    "ACTUAL_PAYMENT_AMOUNT / nullif(SCHEDULED_PAYMENT_AMOUNT, 0) AS PAYMENT_RATIO, "
    "CAST(coalesce(ACTUAL_PAYMENT_AMOUNT = 0, false) AS BIGINT) AS MISSED_PAYMENT, "
    "CAST(coalesce(DAYS_BEFORE_ACTUAL_PAYMENT > DAYS_UNTIL_DUE, false) AS BIGINT) AS LATE_PAYMENT, "
    "DAYS_BEFORE_ACTUAL_PAYMENT - DAYS_UNTIL_DUE AS PAYMENT_DELAY"
)
BLOCKS = {
    "b_summary": block(
        "r_credit_summary",
        KEY,
        _stats("credit_summary") + B.SUMMARY,
        {**_modes("credit_summary"), **B.SUMMARY_MODES},
    ),
    "mapped": (
        f"SELECT r.*, m.CUSTOMER_ID FROM ({RECORDS}) r JOIN (SELECT DISTINCT REQUEST_ID, "
        "CREDIT_RECORD_ID, CUSTOMER_ID FROM r_credit_summary) m "
        "USING (REQUEST_ID, CREDIT_RECORD_ID)"
    ),
    "b_timeline": B.customer_level("mapped", KEY),
    "pos_rows": f"SELECT *, {B.AGE_GROUP} AS LOAN_AGE_GROUP FROM r_cash_pos_records",
    "b_pos": block(
        "pos_rows",
        KEY,
        _stats("cash_pos_records") + B.POS,
        {**_modes("cash_pos_records"), **B.POS_MODES},
    ),
    "b_card": CARD,
    "prior_rows": (
        f"SELECT *, CAST({B.BIN} AS BIGINT) AS DAYS_SINCE_DECISION_BIN FROM (SELECT *, "
        "min(DAYS_SINCE_DECISION) OVER (PARTITION BY REQUEST_ID) AS lo, "
        "max(DAYS_SINCE_DECISION) OVER (PARTITION BY REQUEST_ID) AS hi FROM r_prior_loan_history)"
    ),
    "b_prior": block(
        "prior_rows",
        KEY,
        _stats("prior_loan_history") + B.PRIOR,
        {**_modes("prior_loan_history"), **B.PRIOR_MODES},
    ),
    "inst_rows": f"SELECT *, {RATIO} FROM r_installment_records",
    "b_inst": block("inst_rows", KEY, _stats("installment_records") + B.FLAG_STATS + B.INST, {}),
}
FEATURES = "SELECT p.*, " + ", ".join(
    f"{b}.* EXCLUDE (REQUEST_ID, CUSTOMER_ID)"
    for b in ("b_summary", "b_timeline", "b_pos", "b_card", "b_prior", "b_inst")
) + " FROM r_profile p" + "".join(
    f" LEFT JOIN {b} ON {b}.REQUEST_ID = p.REQUEST_ID AND {b}.CUSTOMER_ID = p.CUSTOMER_ID"
    for b in ("b_summary", "b_timeline", "b_pos", "b_card", "b_prior", "b_inst")
)


def all_child_rows() -> str:
    parts = []
    for t in CHILD_TABLES:
        names = [f.name for f in table_schema(t)]
        parts.append(f"SELECT REQUEST_ID, '{t}' AS \"table\", {', '.join(names)} FROM r_{t}")
    return " UNION ALL BY NAME ".join(parts)


SCENARIO = f"""
SELECT p.REQUEST_ID, coalesce(o.OCCUPATION_TYPE, p.OCCUPATION_TYPE) AS OCCUPATION_TYPE,
 coalesce(o.MONTHLY_INCOME, p.MONTHLY_INCOME) AS MONTHLY_INCOME,
 coalesce(o.LOAN_AMOUNT, p.LOAN_AMOUNT) AS LOAN_AMOUNT,
 coalesce(o.EXTERNAL_CREDIT_SCORE, p.EXTERNAL_CREDIT_SCORE) AS EXTERNAL_CREDIT_SCORE,
 CASE WHEN c.REQUEST_ID IS NOT NULL THEN coalesce(o.LOAN_TERM_MONTHS, c.LOAN_TERM_MONTHS) END
  AS LOAN_TERM_MONTHS
FROM r_profile p LEFT JOIN ({duck(OVERRIDES)}) o ON o.REQUEST_ID = p.REQUEST_ID
LEFT JOIN r_cash_pos_records c ON c.REQUEST_ID = p.REQUEST_ID"""


def oracle() -> dict[str, str]:
    more = "".join(f", {n} AS ({sql})" for n, sql in BLOCKS.items())
    return {
        "payload_profile": with_requests("SELECT * FROM r_profile", []),
        "payload_child_rows": with_requests(all_child_rows(), CHILD_TABLES),
        "payload_rejects": with_requests(
            "SELECT REQUEST_ID, reason FROM all_requests WHERE reason IS NOT NULL", []
        ),
        "payload_features": with_requests(FEATURES, CHILD_TABLES, more),
        "scenario_override": with_requests(SCENARIO, ["cash_pos_records"]),
    }
