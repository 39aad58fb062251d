"""Scoring requests and dirty inputs derived row by row from the star schema.

One request per order. Every child array is built from the order row itself, so
no rows are gathered. The expressions are shared by every engine; some requests
are broken, lack a block, or carry rows of another customer on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.schemas import CHILD_TABLES, LABELS, REQUEST, table_schema
from loanloom.sources.adapters import run_sql

REQUEST_ORDERS = """
SELECT CAST(o_orderkey AS STRING) AS REQUEST_ID, o_orderkey AS k, o_custkey AS CUSTOMER_ID,
 o_totalprice AS price, o_orderstatus AS status, {days:o_orderdate:2001-12-31} AS day,
 c_nationkey AS nation, c_acctbal AS balance
FROM orders JOIN customer ON o_custkey = c_custkey"""

BROKEN = "k % 97 = 0"
NO_PROFILE = "k % 89 = 0"
NO_ID = "k % 83 = 0"
# A block that is missing from the request, or an empty array.
MISSING_BLOCK = {"card_activity": "k % 5 = 0"}
EMPTY_BLOCK = {"cash_pos_records": "k % 7 = 0"}

_STATUS = "CASE (k + {i}) % 4 WHEN 0 THEN 'Status A' WHEN 1 THEN 'Status B' WHEN 2 THEN 'Status C' END"


def _with_fillers(table: str, columns: dict[str, str]) -> dict[str, str]:
    """The columns, and by rule all others that the table declares: some NULL, both signs, all labels."""
    missing = [f for f in table_schema(table, drop=("TARGET",)) if f.name not in columns]
    out = dict(columns)
    for n, field in enumerate(missing):
        if field.dataType.typeName() == "string":
            labels = LABELS[field.name]
            cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
            out[field.name] = f"CASE (k + {n} + {{i}}) % {len(labels) + 1} {cases} END"
        else:
            number = field.dataType.simpleString()
            value = f"CAST((k * {7 + 2 * n} + {{i}}) % 1000 - 300 AS {number})"
            out[field.name] = f"CASE WHEN (k + {{i}}) % {11 + n} = 0 THEN NULL ELSE {value} END"
    return out


PROFILE = {
    "CUSTOMER_ID": "CASE WHEN k % 83 = 0 THEN NULL ELSE CUSTOMER_ID END",
    "OCCUPATION_TYPE": "CASE nation % 6 WHEN 0 THEN 'Job A' WHEN 1 THEN 'Job B' WHEN 2 THEN 'Job C' WHEN 3 THEN 'Job D' WHEN 4 THEN 'Job E' END",
    "MONTHLY_INCOME": "CAST(2000 + balance AS DOUBLE)",
    "LOAN_AMOUNT": "CAST(5000 + (k * 7919) % 145001 AS DOUBLE)",
    "LOAN_TERM_MONTHS": "CAST(6 + k % 67 AS BIGINT)",
    "EMPLOYMENT_DURATION_DAYS": "CAST(-30 - (k * 97) % 14571 AS BIGINT)",
    "EXTERNAL_CREDIT_SCORE": "CASE WHEN k % 17 = 0 THEN NULL ELSE CAST((k * 31) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) END",
}
PROFILE = _with_fillers("customer_profile", PROFILE)
# Per child table: how many rows, and the columns of row {i}.
ROWS = {"credit_summary": 2, "credit_timeline": 4, "prior_loan_history": 2}
CHILDREN = {
    "credit_summary": {
        "CUSTOMER_ID": "CASE WHEN {i} = 1 AND k % 10 = 0 THEN CUSTOMER_ID + 1000000 ELSE CUSTOMER_ID END",
        "CREDIT_RECORD_ID": "CAST(k * 2 + {i} AS BIGINT)",
        "CREDIT_STATUS": "CASE (k + {i}) % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Repaid' ELSE 'Written-Off' END",
        "TYPE_OF_CREDIT": "CASE (k + {i}) % 5 WHEN 0 THEN 'Type A' WHEN 1 THEN 'Type B' WHEN 2 THEN 'Type C' WHEN 3 THEN 'Type D' END",
        "DAYS_SINCE_CREDIT_ISSUED": "CAST(day - {i} AS BIGINT)",
        "DAYS_OVERDUE": "CAST((k * 13 + {i}) % 200 - 120 AS BIGINT)",
        "TOTAL_CREDIT_AMOUNT": "CAST(price + {i} AS DOUBLE)",
        "OUTSTANDING_DEBT": "CASE WHEN status = 'F' THEN NULL ELSE CAST(price * 0.5 AS DOUBLE) END",
        "DAYS_SINCE_CREDIT_UPDATE": "CAST(-((k * 17 + {i}) % 900) AS BIGINT)",
    },
    "credit_timeline": {
        "CREDIT_RECORD_ID": "CAST(k * 2 + CASE WHEN {i} < 2 THEN 0 ELSE 1 END AS BIGINT)",
        "TIME_SINCE_ENTRY": "CAST(-(k % 60) - {i} AS BIGINT)",
        "ACCOUNT_STATUS": "CASE (k + {i}) % 4 WHEN 0 THEN 'On Time' WHEN 1 THEN 'Delayed' WHEN 2 THEN 'Defaulted' END",
    },
    "card_activity": {
        "PRIOR_LOAN_ID": "CAST(k AS BIGINT)",
        "CUSTOMER_ID": "CUSTOMER_ID",
        "TIME_SINCE_ENTRY": "CAST(-(k % 40) AS BIGINT)",
        "CURRENT_CARD_BALANCE": "CAST(price * 0.1 AS DOUBLE)",
        "CARD_CREDIT_LIMIT": "CAST(100 * (k % 10) AS BIGINT)",
        "CURRENT_PAYMENT": "CAST(price * 0.01 AS DOUBLE)",
        "CONTRACT_STATUS": _STATUS,
        "DAYS_PAST_DUE": "CAST(k % 121 AS BIGINT)",
    },
    "cash_pos_records": {
        "PRIOR_LOAN_ID": "CAST(k AS BIGINT)",
        "CUSTOMER_ID": "CUSTOMER_ID",
        "TIME_SINCE_ENTRY": "CAST(-(k % 120) AS BIGINT)",
        "LOAN_TERM_MONTHS": "CAST(6 + k % 67 AS BIGINT)",
        "REMAINING_TERM_MONTHS": "CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 48 AS BIGINT) END",
        "CONTRACT_STATUS": _STATUS,
        "DAYS_PAST_DUE": "CAST(k % 100 AS BIGINT)",
    },
    "installment_records": {
        "PRIOR_LOAN_ID": "CAST(k AS BIGINT)",
        "CUSTOMER_ID": "CUSTOMER_ID",
        "DAYS_UNTIL_DUE": "CAST(day AS BIGINT)",
        "DAYS_BEFORE_ACTUAL_PAYMENT": "CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(day + k % 9 - 4 AS BIGINT) END",
        "SCHEDULED_PAYMENT_AMOUNT": "CASE WHEN k % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(price * 0.02 AS DOUBLE) END",
        "ACTUAL_PAYMENT_AMOUNT": "CASE WHEN k % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(price * 0.015 AS DOUBLE) END",
    },
    "prior_loan_history": {
        "PRIOR_LOAN_ID": "CAST(k * 2 + {i} AS BIGINT)",
        "CUSTOMER_ID": "CUSTOMER_ID",
        "LOAN_CONTRACT_TYPE": "CASE WHEN (k + {i}) % 2 = 0 THEN 'Loan Type A' ELSE 'Loan Type B' END",
        "REQUESTED_LOAN_AMOUNT": "CAST(price * (1 + {i}) AS DOUBLE)",
        "LOAN_AMOUNT": "CASE WHEN (k + {i}) % 3 = 0 THEN NULL ELSE CAST(price * 0.75 AS DOUBLE) END",
        "LOAN_PURPOSE_CATEGORY": "CASE (k + {i}) % 4 WHEN 0 THEN 'Purpose A' WHEN 1 THEN 'Purpose B' WHEN 2 THEN 'Purpose C' END",
        "CONTRACT_STATUS": _STATUS,
        "CLIENT_TYPE": "CASE WHEN (k + {i}) % 3 = 0 THEN 'Client A' ELSE 'Client B' END",
        "DAYS_SINCE_DECISION": "CAST(day - {i} * (k % 50) AS BIGINT)",
        "PLANNED_NUM_PAYMENTS": "CAST(6 + k % 55 AS DOUBLE)",
        "DAYS_UNTIL_FIRST_PAYMENT": "CAST((k * 19 + {i}) % 900 - 450 AS DOUBLE)",
        "DAYS_UNTIL_FINAL_PAYMENT": "CASE WHEN k % 7 = 0 THEN NULL ELSE CAST((k * 23) % 1200 - 600 AS DOUBLE) END",
    },
}
CHILDREN = {table: _with_fillers(table, columns) for table, columns in CHILDREN.items()}

OVERRIDES = """
SELECT CAST(o_orderkey AS STRING) AS REQUEST_ID,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Job E' END AS OCCUPATION_TYPE,
 CAST(1500 + o_orderkey % 4000 AS DOUBLE) AS MONTHLY_INCOME,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(9000 + o_orderkey % 30000 AS DOUBLE) END
   AS LOAN_AMOUNT,
 CAST((o_orderkey % 11) / CAST(10 AS DOUBLE) AS DOUBLE) AS EXTERNAL_CREDIT_SCORE,
 CAST(12 + o_orderkey % 48 AS BIGINT) AS LOAN_TERM_MONTHS
FROM orders WHERE o_orderstatus = 'O'"""

RAW_PROFILE = """
SELECT c_custkey AS ROW_ID,
 CASE c_custkey % 8 WHEN 0 THEN 'abc' WHEN 1 THEN NULL
   WHEN 2 THEN concat(CAST(c_custkey AS STRING), '.5')
   WHEN 3 THEN concat(CAST(c_custkey AS STRING), '.0') WHEN 4 THEN '1e3' WHEN 5 THEN ''
   ELSE CAST(c_custkey AS STRING) END AS CUSTOMER_ID,
 CASE c_custkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '0.5' WHEN 2 THEN '1.5' WHEN 3 THEN '2.5'
   WHEN 4 THEN NULL WHEN 5 THEN '-2.5' ELSE '3' END AS NUM_CHILDREN,
 CASE c_custkey % 5 WHEN 0 THEN '12d' WHEN 1 THEN '1.5e3' WHEN 2 THEN ''
   ELSE CAST(c_acctbal AS STRING) END AS MONTHLY_INCOME,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Housing A' WHEN 'FURNITURE' THEN 'Housing B'
   WHEN 'MACHINERY' THEN 'Castle' WHEN 'AUTOMOBILE' THEN NULL ELSE 'Other' END AS HOUSING_TYPE,
 CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN '12x'
   WHEN 2 THEN concat(CAST(1 + c_custkey % 9 AS STRING), ',234,567') WHEN 3 THEN '1,234.50'
   WHEN 4 THEN '-75' ELSE CAST(c_custkey AS STRING) END AS TYPED_AMOUNT,
 CAST(c_custkey * 10 AS DOUBLE) AS OLD_AMOUNT
FROM customer"""


def _struct(columns: dict[str, str], i: int = 0) -> str:
    fields = ", ".join(f"'{n}', {sql.replace('{i}', str(i))}" for n, sql in columns.items())
    return f"named_struct({fields})"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(REQUEST_ID, body): one JSON request per order.

    A body is about a hundred times its order, and files that are small for orders come as one
    task, so the orders are dealt out evenly before the bodies are made.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = run_sql(spark, sf_dir, REQUEST_ORDERS).repartition(tasks)
    parts = {"customer_profile": f"CASE WHEN NOT ({NO_PROFILE}) THEN {_struct(PROFILE)} END"}
    for table in CHILD_TABLES:
        rows = [_struct(CHILDREN[table], i) for i in range(ROWS.get(table, 1))]
        array = f"array({', '.join(rows)})"
        if table in EMPTY_BLOCK:
            array = f"filter({array}, r -> NOT ({EMPTY_BLOCK[table]}))"
        if table in MISSING_BLOCK:
            array = f"CASE WHEN NOT ({MISSING_BLOCK[table]}) THEN {array} END"
        parts[table] = array
    fields = ", ".join(f"'{n}', {sql}" for n, sql in parts.items())
    body = F.expr(f"to_json(named_struct('CUSTOMER_ID', CUSTOMER_ID, {fields}))")
    broken = F.when(F.expr(BROKEN), '{"customer_profile": ').otherwise(body)
    return orders.select(REQUEST, broken.alias("body"))


def child_sql(table: str) -> str:
    """SQL of the child rows of all readable requests, all declared columns present."""
    types = {f.name: f.dataType.simpleString() for f in table_schema(table)}
    skip = MISSING_BLOCK.get(table) or EMPTY_BLOCK.get(table) or "false"
    selects = []
    for i in range(ROWS.get(table, 1)):
        columns = []
        for name, kind in types.items():
            sql = CHILDREN[table][name].replace("{i}", str(i))
            columns.append(f"CAST({sql} AS {kind}) AS {name}")
        selects.append(
            f"SELECT REQUEST_ID, {', '.join(columns)} FROM requests WHERE NOT ({skip})"
        )
    return " UNION ALL ".join(selects)


def profile_sql() -> str:
    columns = [
        f"CAST({PROFILE[f.name].replace('{i}', '0')} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in table_schema("customer_profile", drop=("TARGET",))
    ]
    return f"SELECT REQUEST_ID, {', '.join(columns)} FROM requests WHERE NOT ({NO_PROFILE})"
