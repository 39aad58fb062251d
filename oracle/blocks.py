"""Oracle SQL of the feature blocks and the wide table."""

from __future__ import annotations

from loanloom.sources.adapters import FILLED
from oracle.build import (
    block,
    count_if,
    flag,
    int_total,
    mean,
    named,
    ratio0,
    share,
    single,
    stats,
    std,
    total,
    with_views,
)

C = "CUSTOMER_ID"

NUMBERS = {
    "credit_summary": (
        ["DAYS_SINCE_CREDIT_ISSUED", "DAYS_OVERDUE", "DAYS_SINCE_CREDIT_UPDATE"],
        [
            "DAYS_UNTIL_CREDIT_END",
            "DAYS_UNTIL_ACTUAL_CREDIT_CLOSED",
            "TOTAL_CREDIT_AMOUNT",
            "OUTSTANDING_DEBT",
            "CREDIT_LIMIT",
            "OVERDUE_BALANCE",
        ],
    ),
    "credit_timeline": (["TIME_SINCE_ENTRY"], []),
    "card_activity": (
        ["TIME_SINCE_ENTRY", "CARD_CREDIT_LIMIT", "DAYS_PAST_DUE", "DAYS_PAST_DUE_90"],
        ["CURRENT_CARD_BALANCE", "CURRENT_PAYMENT", "PRINCIPAL_DUE", "RECEIVABLE_BALANCE"],
    ),
    "cash_pos_records": (
        [
            "TIME_SINCE_ENTRY",
            "LOAN_TERM_MONTHS",
            "REMAINING_TERM_MONTHS",
            "DAYS_PAST_DUE",
            "DAYS_PAST_DUE_90",
        ],
        [],
    ),
    "installment_records": (
        [
            "INSTALLMENT_PLAN_VERSION",
            "INSTALLMENT_SEQUENCE_NUMBER",
            "DAYS_UNTIL_DUE",
            "DAYS_BEFORE_ACTUAL_PAYMENT",
        ],
        ["SCHEDULED_PAYMENT_AMOUNT", "ACTUAL_PAYMENT_AMOUNT"],
    ),
    "prior_loan_history": (
        ["DAYS_SINCE_DECISION"],
        [
            "REQUESTED_LOAN_AMOUNT",
            "LOAN_AMOUNT",
            "PLANNED_NUM_PAYMENTS",
            "DAYS_UNTIL_FIRST_PAYMENT",
            "DAYS_UNTIL_FINAL_PAYMENT",
            "DAYS_UNTIL_TERMINATION",
        ],
    ),
}
TEXTS = {
    "credit_summary": ["CREDIT_STATUS", "CURRENCY_TYPE", "NUM_CREDIT_EXTENSIONS", "TYPE_OF_CREDIT"],
    "credit_timeline": ["ACCOUNT_STATUS"],
    "card_activity": ["CONTRACT_STATUS"],
    "cash_pos_records": ["CONTRACT_STATUS"],
    "prior_loan_history": [
        "LOAN_CONTRACT_TYPE",
        "LOAN_PURPOSE_CATEGORY",
        "CONTRACT_STATUS",
        "CLIENT_TYPE",
    ],
}
for _table in ("card_activity", "prior_loan_history"):
    for _name, _kind in FILLED[_table].items():
        _list = {"bigint": NUMBERS[_table][0], "double": NUMBERS[_table][1], "string": TEXTS[_table]}
        _list[_kind].append(_name)
PREFIX = {
    "credit_summary": "credit_summary",
    "credit_timeline": "credit_timeline",
    "card_activity": "card_activity",
    "cash_pos_records": "cash_pos",
    "installment_records": "installments",
    "prior_loan_history": "prior_loan",
}


def key_of(table: str) -> str:
    return "CREDIT_RECORD_ID" if table == "credit_timeline" else C


def generic_stats(table: str) -> list[str]:
    return stats(PREFIX[table], *NUMBERS[table])


def generic_modes(table: str) -> dict[str, str]:
    return {f"{PREFIX[table]}_agg_{c}_most_frequent": c for c in TEXTS.get(table, [])}


SUMMARY = named(
    "credit_summary",
    {
        "NUM_LOANS": "count(CREDIT_RECORD_ID)",
        "NUM_ACTIVE_LOANS": count_if("CREDIT_STATUS = 'Active'"),
        "NUM_CLOSED_LOANS": count_if("CREDIT_STATUS = 'Repaid'"),
        "TOTAL_CREDIT_AMOUNT": total("TOTAL_CREDIT_AMOUNT"),
        "AVG_CREDIT_AMOUNT": mean("TOTAL_CREDIT_AMOUNT"),
        "TOTAL_DEBT": total("OUTSTANDING_DEBT"),
        "DEBT_CREDIT_RATIO": ratio0(total("OUTSTANDING_DEBT"), total("TOTAL_CREDIT_AMOUNT")),
        "AVG_CREDIT_AGE": f"abs({mean('DAYS_SINCE_CREDIT_ISSUED')}) / 365e0",
        "TIME_SINCE_LAST_UPDATE": "abs(max(DAYS_SINCE_CREDIT_UPDATE)) / 365e0",
        "AVG_REMAINING_CREDIT_TIME": f"abs({mean('DAYS_UNTIL_CREDIT_END')}) / 365e0",
        "NUM_OVERDUE_LOANS": count_if("DAYS_OVERDUE > 0"),
        "TOTAL_OVERDUE_AMOUNT": total("OVERDUE_BALANCE"),
        "PERCENT_ACTIVE": share("CREDIT_STATUS = 'Active'"),
        "HAS_BAD_DEBT": flag("CREDIT_STATUS = 'Written-Off'"),
    },
)
SUMMARY_MODES = {"credit_summary_MOST_COMMON_TYPE_OF_CREDIT": "TYPE_OF_CREDIT"}

OVERDUE = count_if("ACCOUNT_STATUS IN ('Delayed', 'Defaulted')")
WORST = (
    "CASE coalesce(max(CASE ACCOUNT_STATUS WHEN 'Defaulted' THEN 3 WHEN 'Delayed' THEN 2 "
    "ELSE 1 END), 1) WHEN 3 THEN 'Defaulted' WHEN 2 THEN 'Delayed' ELSE 'On Time' END"
)
TIMELINE = named(
    "credit_timeline",
    {
        "NUM_MONTHS": "count(TIME_SINCE_ENTRY)",
        "NUM_CLOSED_MONTHS": count_if("ACCOUNT_STATUS = 'Defaulted'"),
        "NUM_ACTIVE_MONTHS": count_if("ACCOUNT_STATUS = 'On Time'"),
        "TOTAL_OVERDUE_MONTHS": OVERDUE,
        "OLDEST_RECORD": "min(TIME_SINCE_ENTRY)",
        "MOST_RECENT_RECORD": "max(TIME_SINCE_ENTRY)",
        "CREDIT_HISTORY_LENGTH": "max(TIME_SINCE_ENTRY) - min(TIME_SINCE_ENTRY)",
        "RECENT_OVERDUE_MONTHS": OVERDUE,
        "MAX_OVERDUE_STATUS": WORST,
        "PERCENT_CLOSED": share("ACCOUNT_STATUS = 'Defaulted'"),
        "PERCENT_ACTIVE": share("ACCOUNT_STATUS = 'On Time'"),
    },
)
TIMELINE_MODES = {"credit_timeline_MOST_COMMON_STATUS": "ACCOUNT_STATUS"}

CARD = named(
    "card_activity",
    {
        "NUM_CREDIT_CARDS": "count(PRIOR_LOAN_ID)",
        "NUM_ACTIVE_CARDS": count_if("CONTRACT_STATUS = 'Status A'"),
        "NUM_CLOSED_CARDS": count_if("CONTRACT_STATUS = 'Status B'"),
        "TOTAL_CREDIT_LIMIT": int_total("CARD_CREDIT_LIMIT"),
        "TOTAL_CREDIT_BALANCE": total("CURRENT_CARD_BALANCE"),
        "TOTAL_DEBT": total("RECEIVABLE_BALANCE"),
        "CREDIT_UTILIZATION_RATIO": ratio0(
            total("CURRENT_CARD_BALANCE"), f"CAST({int_total('CARD_CREDIT_LIMIT')} AS DOUBLE)"
        ),
        "TOTAL_OVERDUE": total("PRINCIPAL_DUE"),
        "NUM_DPD_0_30": count_if("DAYS_PAST_DUE > 0 AND DAYS_PAST_DUE <= 30"),
        "NUM_DPD_30_90": count_if("DAYS_PAST_DUE > 30 AND DAYS_PAST_DUE <= 90"),
        "NUM_DPD_90_PLUS": count_if("DAYS_PAST_DUE > 90"),
        "STATUS_ACTIVE_RATIO": share("CONTRACT_STATUS = 'Status A'"),
        "STATUS_COMPLETED_RATIO": share("CONTRACT_STATUS = 'Status B'"),
    },
)


def _last(column: str, n: int) -> str:
    x = f"CASE WHEN rn <= {n} THEN {column} END"
    return mean(x)


LAST_N = f"""
SELECT CUSTOMER_ID,
 {_last('CURRENT_CARD_BALANCE', 6)} AS card_activity_AVG_BALANCE_LAST_6M,
 {_last('CURRENT_CARD_BALANCE', 12)} AS card_activity_AVG_BALANCE_LAST_12M,
 {_last('CURRENT_PAYMENT', 6)} AS card_activity_AVG_PAYMENT_LAST_6M,
 {_last('CURRENT_PAYMENT', 12)} AS card_activity_AVG_PAYMENT_LAST_12M
FROM (SELECT *, row_number() OVER (PARTITION BY CUSTOMER_ID
  ORDER BY TIME_SINCE_ENTRY DESC, PRIOR_LOAN_ID DESC) AS rn FROM v_card_activity)
WHERE CUSTOMER_ID IS NOT NULL GROUP BY CUSTOMER_ID"""

AGE_GROUP = (
    "CASE WHEN TIME_SINCE_ENTRY > -100 AND TIME_SINCE_ENTRY <= -48 THEN 'Loan Tier A' "
    "WHEN TIME_SINCE_ENTRY > -48 AND TIME_SINCE_ENTRY <= -24 THEN 'Loan Tier B' "
    "WHEN TIME_SINCE_ENTRY > -24 AND TIME_SINCE_ENTRY <= 0 THEN 'Loan Tier C' END"
)
POS_ROWS = f"(SELECT *, {AGE_GROUP} AS LOAN_AGE_GROUP FROM v_cash_pos_records)"
POS = named(
    "cash_pos",
    {
        "NUM_POS_LOANS": "count(DISTINCT PRIOR_LOAN_ID)",
        "NUM_ACTIVE_POS_LOANS": count_if("CONTRACT_STATUS = 'Status A'"),
        "NUM_COMPLETED_POS_LOANS": count_if("CONTRACT_STATUS = 'Status B'"),
        "AVG_POS_CREDIT_DURATION": f"abs({mean('TIME_SINCE_ENTRY')}) / 12e0",
        "TIME_SINCE_LAST_POS_UPDATE": "abs(max(TIME_SINCE_ENTRY)) / 12e0",
        "AVG_REMAINING_INSTALLMENT_TIME": f"abs({mean('REMAINING_TERM_MONTHS')})",
        "NUM_OVERDUE_POS_CREDITS": count_if("DAYS_PAST_DUE > 0"),
        "TOTAL_OVERDUE_DAYS_POS": int_total("DAYS_PAST_DUE"),
        "MAX_OVERDUE_DAYS_POS": "max(DAYS_PAST_DUE)",
        "NUM_SEVERE_OVERDUE_POS": count_if("DAYS_PAST_DUE_90 > 0"),
        "PERCENT_ACTIVE_MONTHS": share("CONTRACT_STATUS = 'Status A'"),
        "HAS_RETURNED_CONTRACT": flag("CONTRACT_STATUS = 'Status C'"),
    },
)
POS_MODES = {
    "cash_pos_agg_LOAN_AGE_GROUP_most_frequent": "LOAN_AGE_GROUP",
    "cash_pos_MOST_COMMON_CONTRACT_STATUS": "CONTRACT_STATUS",
}

FLAG_COLUMNS = """
 CAST(CAST(ACTUAL_PAYMENT_AMOUNT AS DOUBLE) / nullif(CAST(SCHEDULED_PAYMENT_AMOUNT AS DOUBLE), 0)
  AS DECIMAL(18,8)) AS PAYMENT_RATIO,
 CAST(coalesce(ACTUAL_PAYMENT_AMOUNT = 0, false) AS BIGINT) AS MISSED_PAYMENT,
 CAST(coalesce(DAYS_BEFORE_ACTUAL_PAYMENT > DAYS_UNTIL_DUE, false) AS BIGINT) AS LATE_PAYMENT,
 DAYS_BEFORE_ACTUAL_PAYMENT - DAYS_UNTIL_DUE AS PAYMENT_DELAY"""
INST_ROWS = f"(SELECT *, {FLAG_COLUMNS} FROM v_installment_records)"
FLAG_STATS = [
    f"coalesce({mean('PAYMENT_RATIO')}, 1e0) AS installments_agg_PAYMENT_RATIO_mean",
    f"{total('PAYMENT_RATIO')} AS installments_agg_PAYMENT_RATIO_sum",
    "coalesce(CAST(max(PAYMENT_RATIO) AS DOUBLE), 1e0) AS installments_agg_PAYMENT_RATIO_max",
    "coalesce(CAST(min(PAYMENT_RATIO) AS DOUBLE), 1e0) AS installments_agg_PAYMENT_RATIO_min",
    *stats("installments", ["MISSED_PAYMENT", "LATE_PAYMENT", "PAYMENT_DELAY"], []),
]
PAID, DUE = "DAYS_BEFORE_ACTUAL_PAYMENT", "DAYS_UNTIL_DUE"
INST = named(
    "installments",
    {
        "NUM_PAYMENTS": "count(PRIOR_LOAN_ID)",
        "NUM_MISSED_PAYMENTS": int_total("MISSED_PAYMENT"),
        "MISSED_PAYMENT_RATIO": mean("MISSED_PAYMENT"),
        "MEAN_INSTALMENT_AMOUNT": mean("SCHEDULED_PAYMENT_AMOUNT"),
        "MEAN_ACTUAL_PAYMENT": mean("ACTUAL_PAYMENT_AMOUNT"),
        "SUM_INSTALMENT_AMOUNT": total("SCHEDULED_PAYMENT_AMOUNT"),
        "SUM_ACTUAL_PAYMENT": total("ACTUAL_PAYMENT_AMOUNT"),
        "PAYMENT_COMPLIANCE_RATIO": ratio0(
            total("ACTUAL_PAYMENT_AMOUNT"), total("SCHEDULED_PAYMENT_AMOUNT")
        ),
        "MEAN_DAYS_ENTRY_PAYMENT": mean(PAID),
        "STD_DAYS_ENTRY_PAYMENT": std(PAID),
        "MIN_DAYS_ENTRY_PAYMENT": f"min({PAID})",
        "MAX_DAYS_ENTRY_PAYMENT": f"max({PAID})",
        "MEAN_DAYS_INSTALMENT": mean(DUE),
        "MIN_DAYS_INSTALMENT": f"min({DUE})",
        "MAX_DAYS_INSTALMENT": f"max({DUE})",
        "TIME_SINCE_LAST_PAYMENT": f"abs(max({PAID}))",
        "ABS_MEAN_PAYMENT_DELAY": f"abs({mean(PAID)} - {mean(DUE)})",
        "MEAN_PAYMENT_DELAY": mean("PAYMENT_DELAY"),
        "STD_PAYMENT_DELAY": std("PAYMENT_DELAY"),
        "NUM_LATE_PAYMENTS": int_total("LATE_PAYMENT"),
        "LATE_PAYMENT_RATIO": mean("LATE_PAYMENT"),
    },
)

BIN = (
    "CASE WHEN DAYS_SINCE_DECISION IS NULL THEN NULL WHEN hi = lo THEN 9 ELSE "
    "greatest(0, least(19, (20 * (DAYS_SINCE_DECISION - lo) + (hi - lo) - 1) "
    "// nullif(hi - lo, 0) - 1)) END"
)
PRIOR_ROWS = (
    f"(SELECT p.*, CAST({BIN} AS BIGINT) AS DAYS_SINCE_DECISION_BIN FROM v_prior_loan_history p, "
    "(SELECT min(DAYS_SINCE_DECISION) AS lo, max(DAYS_SINCE_DECISION) AS hi "
    "FROM v_prior_loan_history))"
)
D, ASK, GOT = "DAYS_SINCE_DECISION", "REQUESTED_LOAN_AMOUNT", "LOAN_AMOUNT"
PRIOR = stats("prior_loan", ["DAYS_SINCE_DECISION_BIN"], []) + named(
    "prior_loan",
    {
        "NUM_APPLICATIONS": "count(PRIOR_LOAN_ID)",
        "NUM_APPROVED_LOANS": count_if("CONTRACT_STATUS = 'Status A'"),
        "NUM_REFUSED_LOANS": count_if("CONTRACT_STATUS = 'Status B'"),
        "NUM_CANCELED_LOANS": count_if("CONTRACT_STATUS = 'Status C'"),
        "APPROVAL_RATE": share("CONTRACT_STATUS = 'Status A'"),
        "NUM_REVOLVING_LOANS": count_if("LOAN_CONTRACT_TYPE = 'Loan Type A'"),
        "NUM_CASH_LOANS": count_if("LOAN_CONTRACT_TYPE = 'Loan Type B'"),
        "NUM_REPEAT_LOANS": count_if("CLIENT_TYPE = 'Client A'"),
        "TOTAL_APPLICATION_AMOUNT": total(ASK),
        "AVG_APPLICATION_AMOUNT": mean(ASK),
        "MAX_APPLICATION_AMOUNT": f"CAST(max({ASK}) AS DOUBLE)",
        "MIN_APPLICATION_AMOUNT": f"CAST(min({ASK}) AS DOUBLE)",
        "STD_APPLICATION_AMOUNT": std(ASK),
        "TOTAL_APPROVED_AMOUNT": total(GOT),
        "AVG_APPROVED_AMOUNT": mean(GOT),
        "MAX_APPROVED_AMOUNT": f"CAST(max({GOT}) AS DOUBLE)",
        "MIN_APPROVED_AMOUNT": f"CAST(min({GOT}) AS DOUBLE)",
        "STD_APPROVED_AMOUNT": std(GOT),
        "TOTAL_PAYMENT_AMOUNT": total("PLANNED_NUM_PAYMENTS"),
        "APPROVAL_AMOUNT_RATIO": ratio0(total(GOT), total(ASK)),
        "APPLICATION_TO_CREDIT_RATIO": ratio0(total(ASK), total(GOT)),
        "AVG_TIME_SINCE_APPLICATION": f"abs({mean(D)}) / 365e0",
        "MAX_TIME_SINCE_APPLICATION": f"abs(min({D})) / 365e0",
        "TIME_SINCE_LAST_APPLICATION": f"abs(max({D})) / 365e0",
        "AVG_LOAN_DURATION": f"abs({mean('DAYS_UNTIL_TERMINATION')}) / 365e0",
        "MAX_LOAN_DURATION": "abs(CAST(max(DAYS_UNTIL_TERMINATION) AS DOUBLE)) / 365e0",
        "AVG_TIME_TO_FIRST_PAYMENT": f"abs({mean('DAYS_UNTIL_FIRST_PAYMENT')}) / 365e0",
        "AVG_TIME_REMAINING": f"abs({mean('DAYS_UNTIL_FINAL_PAYMENT')}) / 365e0",
        "NUM_OVERDUE_APPLICATIONS": count_if("DAYS_UNTIL_FIRST_PAYMENT < 0"),
        "TOTAL_OVERDUE_AMOUNT": count_if("DAYS_UNTIL_FINAL_PAYMENT < 0"),
        "PROPORTION_OVERDUE_APPLICATIONS": share("DAYS_UNTIL_FINAL_PAYMENT < 0"),
        "PERCENT_APPROVED": share("CONTRACT_STATUS = 'Status A'"),
        "HAS_REFUSALS": flag("CONTRACT_STATUS = 'Status B'"),
    },
)
PRIOR_MODES = {
    "prior_loan_MOST_COMMON_CONTRACT_TYPE": "LOAN_CONTRACT_TYPE",
    "prior_loan_MOST_COMMON_LOAN_PURPOSE": "LOAN_PURPOSE_CATEGORY",
}

# Record level of the timeline and its roll-up to customers.
RECORD_LEVEL = block(
    "v_credit_timeline",
    "CREDIT_RECORD_ID",
    generic_stats("credit_timeline") + TIMELINE,
    {**generic_modes("credit_timeline"), **TIMELINE_MODES},
)
MAPPING = (
    "SELECT DISTINCT CREDIT_RECORD_ID, CUSTOMER_ID FROM v_credit_summary "
    "WHERE CREDIT_RECORD_ID IS NOT NULL AND CUSTOMER_ID IS NOT NULL"
)
MAPPED = f"(SELECT r.*, m.CUSTOMER_ID FROM ({RECORD_LEVEL}) r JOIN ({MAPPING}) m USING (CREDIT_RECORD_ID))"
T = "credit_timeline"
RECORD_INTS = [
    f"{T}_agg_TIME_SINCE_ENTRY_sum",
    f"{T}_agg_TIME_SINCE_ENTRY_max",
    f"{T}_agg_TIME_SINCE_ENTRY_min",
    f"{T}_NUM_MONTHS",
    f"{T}_NUM_CLOSED_MONTHS",
    f"{T}_NUM_ACTIVE_MONTHS",
    f"{T}_TOTAL_OVERDUE_MONTHS",
    f"{T}_OLDEST_RECORD",
    f"{T}_MOST_RECENT_RECORD",
    f"{T}_CREDIT_HISTORY_LENGTH",
    f"{T}_RECENT_OVERDUE_MONTHS",
]
RECORD_DOUBLES = [f"{T}_agg_TIME_SINCE_ENTRY_mean", f"{T}_PERCENT_CLOSED", f"{T}_PERCENT_ACTIVE"]
RECORD_TEXTS = [
    f"{T}_agg_ACCOUNT_STATUS_most_frequent",
    f"{T}_MAX_OVERDUE_STATUS",
    f"{T}_MOST_COMMON_STATUS",
]


def customer_level(source: str = "mapped", key: str = C) -> str:
    out = []
    for x in RECORD_INTS:
        out += [
            f"min({x}) AS {x}_min",
            f"max({x}) AS {x}_max",
            f"{mean(x)} AS {x}_mean",
            f"{int_total(x)} AS {x}_sum",
        ]
    for x in RECORD_DOUBLES:
        out += [
            f"min({x}) AS {x}_min",
            f"max({x}) AS {x}_max",
            f"{single(mean(x))} AS {x}_mean",
            f"{single(total(x))} AS {x}_sum",
        ]
    modes = {f"{x}_most_frequent": x for x in RECORD_TEXTS}
    return block(source, key, out, modes)


UNMAPPED = f"""
SELECT records, count(value) AS "count", round({mean('value')}, 6) AS mean,
 round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
 round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
 round(quantile_cont(value, 0.75), 6) AS q75
FROM (SELECT CASE WHEN m.CUSTOMER_ID IS NULL THEN 'unmapped' ELSE 'mapped' END AS records,
  r.credit_timeline_agg_TIME_SINCE_ENTRY_mean AS value
 FROM ({block("v_credit_timeline", "CREDIT_RECORD_ID", generic_stats("credit_timeline"), {})}) r
 LEFT JOIN ({MAPPING}) m USING (CREDIT_RECORD_ID))
GROUP BY records"""

CARD_FEATURES = f"SELECT f.*, l.* EXCLUDE (CUSTOMER_ID) FROM ({block('v_card_activity', C, CARD, {})}) f LEFT JOIN ({LAST_N}) l USING (CUSTOMER_ID)"
CARD_BLOCK = (
    "SELECT f.*, l.* EXCLUDE (CUSTOMER_ID) FROM ("
    + block(
        "v_card_activity", C, generic_stats("card_activity") + CARD, generic_modes("card_activity")
    )
    + f") f LEFT JOIN ({LAST_N}) l USING (CUSTOMER_ID)"
)

BLOCKS = {
    "b_summary": block(
        "v_credit_summary",
        C,
        generic_stats("credit_summary") + SUMMARY,
        {**generic_modes("credit_summary"), **SUMMARY_MODES},
    ),
    "mapped": MAPPED[1:-1],
    "b_timeline": customer_level(),
    "pos_rows": POS_ROWS[1:-1],
    "b_pos": block(
        "pos_rows",
        C,
        generic_stats("cash_pos_records") + POS,
        {**generic_modes("cash_pos_records"), **POS_MODES},
    ),
    "b_card": CARD_BLOCK,
    "prior_rows": PRIOR_ROWS[1:-1],
    "b_prior": block(
        "prior_rows",
        C,
        generic_stats("prior_loan_history") + PRIOR,
        {**generic_modes("prior_loan_history"), **PRIOR_MODES},
    ),
    "inst_rows": INST_ROWS[1:-1],
    "b_inst": block("inst_rows", C, generic_stats("installment_records") + FLAG_STATS + INST, {}),
}


def with_blocks(query: str, names: list[str]) -> str:
    """Prefix the named block CTEs (and, through them, the adapter views)."""
    ctes = ", ".join(f"{n} AS ({BLOCKS[n]})" for n in names)
    head, tail = with_views(f"{ctes} {query}").split(ctes)
    return f"{head.rstrip()},\n{ctes}{tail}"


WIDE_NAMES = list(BLOCKS)
_MONEY = ["MONTHLY_INCOME", "LOAN_AMOUNT"]
_MONEY += [n for n, kind in FILLED["customer_profile"].items() if kind == "double"]
WIDE = (
    f"SELECT p.* EXCLUDE (TARGET, {', '.join(_MONEY)}), "
    + "".join(f"CAST(p.{n} AS DOUBLE) AS {n}, " for n in _MONEY)
    + ", ".join(
        f"{b}.* EXCLUDE (CUSTOMER_ID)"
        for b in ("b_summary", "b_timeline", "b_pos", "b_card", "b_prior", "b_inst")
    )
    + " FROM v_customer_profile p"
    + "".join(
        f" LEFT JOIN {b} ON {b}.CUSTOMER_ID = p.CUSTOMER_ID"
        for b in ("b_summary", "b_timeline", "b_pos", "b_card", "b_prior", "b_inst")
    )
)

_I = PREFIX["installment_records"]
_RAW = [s.rsplit(" AS ", 1)[1] for s in generic_stats("installment_records")]
_DELAYS = {
    f"{_I}_ABS_MEAN_PAYMENT_DELAY": f"{_I}_MEAN_PAYMENT_DELAY_x",
    f"{_I}_MEAN_PAYMENT_DELAY": f"{_I}_MEAN_PAYMENT_DELAY_y",
}
_LAMBDAS = {f"{x}_most_frequent": f"{x}_<lambda>" for x in RECORD_TEXTS}
# The raw installment statistics twice, the two delays and the record-level modes renamed.
COMPAT = (
    f"SELECT w.* EXCLUDE ({', '.join([*_RAW, *_DELAYS, *_LAMBDAS])}), "
    + ", ".join(f"w.{n} AS {n}_x, w.{n} AS {n}_y" for n in _RAW)
    + "".join(f', w.{n} AS "{new}"' for n, new in {**_DELAYS, **_LAMBDAS}.items())
    + f" FROM ({WIDE}) w"
)


def oracle() -> dict[str, str]:
    out = {
        "credit_summary_features": with_views(block("v_credit_summary", C, SUMMARY, SUMMARY_MODES)),
        "credit_timeline_features": with_views(
            block("v_credit_timeline", "CREDIT_RECORD_ID", TIMELINE, TIMELINE_MODES)
        ),
        "card_activity_features": with_views(CARD_FEATURES),
        "card_last_n_avg": with_views(LAST_N),
        "cash_pos_features": with_views(block(POS_ROWS, C, POS, POS_MODES)),
        "installment_features": with_views(block(INST_ROWS, C, FLAG_STATS + INST, {})),
        "prior_loan_features": with_views(block(PRIOR_ROWS, C, PRIOR, PRIOR_MODES)),
        "max_overdue_status": with_views(
            block(
                "v_credit_timeline",
                "CREDIT_RECORD_ID",
                [f"{WORST} AS credit_timeline_MAX_OVERDUE_STATUS"],
                {},
            )
        ),
        "record_customer_map": with_views(MAPPING),
        "timeline_unmapped": with_views(UNMAPPED),
        "timeline_mapping": with_views(f"SELECT * FROM {MAPPED}"),
        "timeline_final": with_blocks("SELECT * FROM b_timeline", ["mapped", "b_timeline"]),
        "wide_features": with_blocks(WIDE, WIDE_NAMES),
        "wide_features_compat": with_blocks(COMPAT, WIDE_NAMES),
        "installment_row_flags": with_views(
            "SELECT CUSTOMER_ID, PRIOR_LOAN_ID, INSTALLMENT_SEQUENCE_NUMBER, "
            "CAST(PAYMENT_RATIO AS DOUBLE) AS PAYMENT_RATIO, MISSED_PAYMENT, LATE_PAYMENT, "
            f"PAYMENT_DELAY FROM {INST_ROWS}"
        ),
        "loan_age_group": with_views(
            "SELECT CUSTOMER_ID, PRIOR_LOAN_ID, TIME_SINCE_ENTRY, LOAN_AGE_GROUP FROM " + POS_ROWS
        ),
        "pos_loans_by_sketch": with_views(
            "SELECT CUSTOMER_ID, count(DISTINCT PRIOR_LOAN_ID) AS NUM_POS_LOANS FROM v_cash_pos_records "
            "WHERE CUSTOMER_ID IS NOT NULL AND TIME_SINCE_ENTRY IS NOT NULL GROUP BY CUSTOMER_ID"
        ),
        "customers_by_month": with_views(
            "SELECT TIME_SINCE_ENTRY, count(DISTINCT CUSTOMER_ID) AS customers, TRUE AS within_bound "
            "FROM v_cash_pos_records WHERE TIME_SINCE_ENTRY IS NOT NULL GROUP BY TIME_SINCE_ENTRY"
        ),
        "decision_bin": with_views(
            "SELECT CUSTOMER_ID, PRIOR_LOAN_ID, DAYS_SINCE_DECISION, DAYS_SINCE_DECISION_BIN FROM "
            + PRIOR_ROWS
        ),
    }
    for table in NUMBERS:
        out[f"numeric_agg_{table}"] = with_views(
            block(f"v_{table}", key_of(table), generic_stats(table), {})
        )
    for table in TEXTS:
        out[f"categorical_mode_{table}"] = with_views(
            block(f"v_{table}", key_of(table), [], generic_modes(table))
        )
    return out
