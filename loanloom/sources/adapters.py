"""The seven lending tables, derived row by row from a star schema of orders.

The SQL below is shared by every engine that reads the same Parquet files: two
markers differ by dialect, ``{days:COLUMN:DAY}`` (whole days from DAY, negative
before it) and ``{money}`` (DOUBLE, or DECIMAL(18,4) for exact sums). Raw columns
that no rule of the data model ties to others are filled from the row's key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from loanloom.schemas import LABELS, TABLE_COLUMNS

STAR_TABLES = ["customer", "orders", "lineitem", "events"]

BASE = {
    "customer_profile": """
SELECT c_custkey AS CUSTOMER_ID,
 CASE c_nationkey % 6 WHEN 0 THEN 'Job A' WHEN 1 THEN 'Job B' WHEN 2 THEN 'Job C'
   WHEN 3 THEN 'Job D' WHEN 4 THEN 'Job E' END AS OCCUPATION_TYPE,
 CASE WHEN c_custkey % 2 = 0 THEN 'Loan Type A' ELSE 'Loan Type B' END AS LOAN_CONTRACT_TYPE,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'Housing A' WHEN 'FURNITURE' THEN 'Housing B'
   WHEN 'MACHINERY' THEN 'Housing C' ELSE 'Other' END AS HOUSING_TYPE,
 CAST(1000 + (c_acctbal + 1000) * 0.8 AS {money}) AS MONTHLY_INCOME,
 CAST(5000 + (c_custkey * 7919) % 145001 AS {money}) AS LOAN_AMOUNT,
 CAST(6 + c_custkey % 67 AS BIGINT) AS LOAN_TERM_MONTHS,
 CAST(-30 - (c_custkey * 97) % 14571 AS BIGINT) AS EMPLOYMENT_DURATION_DAYS,
 CASE WHEN c_custkey % 17 = 0 THEN NULL
   ELSE CAST((c_custkey * 31) % 101 AS DOUBLE) / 100.0 END AS EXTERNAL_CREDIT_SCORE,
 CAST(CASE WHEN (c_custkey * 7919) % 1000 < 550 - 5 * ((c_custkey * 31) % 101)
   + CASE c_nationkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 100 ELSE 0 END
   THEN 1 ELSE 0 END AS BIGINT) AS TARGET
FROM customer""",
    "credit_summary": """
SELECT o_custkey AS CUSTOMER_ID, o_orderkey AS CREDIT_RECORD_ID,
 CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Repaid'
   ELSE 'Written-Off' END AS CREDIT_STATUS,
 CASE o_orderkey % 3 WHEN 0 THEN 'Currency X' WHEN 1 THEN 'Currency Y'
   ELSE 'Currency Z' END AS CURRENCY_TYPE,
 CASE o_orderkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Once' WHEN 2 THEN 'Multiple' END
   AS NUM_CREDIT_EXTENSIONS,
 CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Type A' WHEN '2' THEN 'Type B'
   WHEN '3' THEN 'Type C' WHEN '4' THEN 'Type D' END AS TYPE_OF_CREDIT,
 {days:o_orderdate:2001-12-31} AS DAYS_SINCE_CREDIT_ISSUED,
 CAST((o_orderkey * 13) % 200 - 120 AS BIGINT) AS DAYS_OVERDUE,
 CASE WHEN o_orderstatus = 'F' THEN NULL
   ELSE CAST((o_orderkey * 29) % 3650 AS {money}) END AS DAYS_UNTIL_CREDIT_END,
 CASE WHEN o_orderstatus = 'F' THEN CAST(-((o_orderkey * 29) % 2000) AS {money}) END
   AS DAYS_UNTIL_ACTUAL_CREDIT_CLOSED,
 CASE WHEN o_orderkey % 23 = 0 THEN CAST(0 AS {money})
   ELSE CAST(o_totalprice AS {money}) END AS TOTAL_CREDIT_AMOUNT,
 CASE o_orderstatus WHEN 'O' THEN CAST(o_totalprice * 0.5 AS {money})
   WHEN 'F' THEN CAST(0 AS {money}) END AS OUTSTANDING_DEBT,
 CAST((o_orderkey * 11) % 50000 AS {money}) AS CREDIT_LIMIT,
 CASE WHEN (o_orderkey * 13) % 200 > 120 THEN CAST((o_orderkey * 7) % 5000 AS {money})
   ELSE CAST(0 AS {money}) END AS OVERDUE_BALANCE,
 CAST(-((o_orderkey * 17) % 900) AS BIGINT) AS DAYS_SINCE_CREDIT_UPDATE
FROM orders""",
    "credit_timeline": """
SELECT CASE WHEN l_orderkey % 101 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END
   AS CREDIT_RECORD_ID,
 CAST(ceil({days:l_shipdate:2001-12-31} / 30.0) AS BIGINT) AS TIME_SINCE_ENTRY,
 CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'N' THEN 'On Time'
   WHEN l_returnflag = 'A' THEN 'Delayed' ELSE 'Defaulted' END AS ACCOUNT_STATUS
FROM lineitem""",
    "card_activity": """
SELECT event_id AS PRIOR_LOAN_ID, user_id AS CUSTOMER_ID,
 {days:ts:2024-01-31} AS TIME_SINCE_ENTRY,
 CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(value AS {money}) END
   AS CURRENT_CARD_BALANCE,
 CAST(100 * (event_id % 10) AS BIGINT) AS CARD_CREDIT_LIMIT,
 CAST(value * 0.1 AS {money}) AS CURRENT_PAYMENT,
 CASE WHEN event_type = 'error' THEN CAST(value * 0.5 AS {money})
   ELSE CAST(0 AS {money}) END AS PRINCIPAL_DUE,
 CAST(value * 0.75 AS {money}) AS RECEIVABLE_BALANCE,
 CASE event_type WHEN 'click' THEN 'Status A' WHEN 'view' THEN 'Status B'
   WHEN 'signup' THEN NULL ELSE 'Status C' END AS CONTRACT_STATUS,
 CASE WHEN event_type = 'error' THEN CAST(event_id % 121 AS BIGINT)
   ELSE CAST(0 AS BIGINT) END AS DAYS_PAST_DUE,
 CASE WHEN event_type = 'error' AND event_id % 121 > 90
   THEN CAST(event_id % 121 - 90 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS DAYS_PAST_DUE_90
FROM events""",
    "cash_pos_records": """
SELECT l_orderkey AS PRIOR_LOAN_ID, o_custkey AS CUSTOMER_ID,
 CAST(ceil({days:l_shipdate:2001-12-31} / 24.0) AS BIGINT) AS TIME_SINCE_ENTRY,
 CAST(6 + l_partkey % 67 AS BIGINT) AS LOAN_TERM_MONTHS,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) END
   AS REMAINING_TERM_MONTHS,
 CASE l_returnflag WHEN 'N' THEN 'Status A' WHEN 'A' THEN 'Status B' ELSE 'Status C' END
   AS CONTRACT_STATUS,
 CASE WHEN l_linestatus = 'F' THEN CAST(0 AS BIGINT)
   ELSE CAST(l_suppkey % 120 AS BIGINT) END AS DAYS_PAST_DUE,
 CASE WHEN l_linestatus = 'O' AND l_suppkey % 120 > 90
   THEN CAST(l_suppkey % 120 - 90 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS DAYS_PAST_DUE_90
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "installment_records": """
SELECT l_orderkey AS PRIOR_LOAN_ID, o_custkey AS CUSTOMER_ID,
 CAST(l_suppkey % 3 AS BIGINT) AS INSTALLMENT_PLAN_VERSION,
 CAST(l_linenumber AS BIGINT) AS INSTALLMENT_SEQUENCE_NUMBER,
 {days:o_orderdate:2001-12-31} + 30 * l_linenumber AS DAYS_UNTIL_DUE,
 CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE {days:l_shipdate:2001-12-31} END
   AS DAYS_BEFORE_ACTUAL_PAYMENT,
 CASE WHEN l_partkey % 31 = 0 THEN CAST(0 AS {money})
   ELSE CAST(l_extendedprice AS {money}) END AS SCHEDULED_PAYMENT_AMOUNT,
 CASE WHEN l_partkey % 29 = 0 THEN CAST(0 AS {money})
   ELSE CAST(l_extendedprice * (1 - l_discount) AS {money}) END AS ACTUAL_PAYMENT_AMOUNT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prior_loan_history": """
SELECT o_orderkey AS PRIOR_LOAN_ID, o_custkey AS CUSTOMER_ID,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Loan Type A' ELSE 'Loan Type B' END AS LOAN_CONTRACT_TYPE,
 CAST(o_totalprice AS {money}) AS REQUESTED_LOAN_AMOUNT,
 CASE o_orderstatus WHEN 'F' THEN CAST(o_totalprice * 0.75 AS {money})
   WHEN 'O' THEN CAST(0 AS {money}) END AS LOAN_AMOUNT,
 CASE o_orderkey % 4 WHEN 0 THEN 'Purpose A' WHEN 1 THEN 'Purpose B' WHEN 2 THEN 'Purpose C' END
   AS LOAN_PURPOSE_CATEGORY,
 CASE o_orderstatus WHEN 'F' THEN 'Status A' WHEN 'O' THEN 'Status B' ELSE 'Status C' END
   AS CONTRACT_STATUS,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Client A' ELSE 'Client B' END AS CLIENT_TYPE,
 {days:o_orderdate:2001-12-31} AS DAYS_SINCE_DECISION,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(6 + o_orderkey % 55 AS {money}) END
   AS PLANNED_NUM_PAYMENTS,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL
   ELSE CAST((o_orderkey * 19) % 900 - 450 AS {money}) END AS DAYS_UNTIL_FIRST_PAYMENT,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL
   ELSE CAST((o_orderkey * 23) % 1200 - 600 AS {money}) END AS DAYS_UNTIL_FINAL_PAYMENT,
 CAST((o_orderkey * 5) % 2000 - 500 AS {money}) AS DAYS_UNTIL_TERMINATION
FROM orders""",
}

# The key whose remainders fill the other columns of a table.
FILL_KEYS = {
    "customer_profile": "CUSTOMER_ID",
    "card_activity": "PRIOR_LOAN_ID",
    "prior_loan_history": "PRIOR_LOAN_ID",
}


def _undefined(table: str) -> dict[str, str]:
    """Declared columns that the table's base view lacks, with their types."""
    present = set(re.findall(r"\bAS\s+(\w+)\s*(?:,|\nFROM)", BASE[table]))
    declared = (item.split() for item in TABLE_COLUMNS[table].split(","))
    return {name: kind for name, kind in declared if name not in present}


# Columns filled by rule, with their types.
FILLED = {table: _undefined(table) for table in FILL_KEYS}


def _filler(key: str, n: int, name: str, kind: str) -> str:
    """A value of the n-th filled column: some rows NULL, numbers of both signs, all labels."""
    if kind == "string":
        labels = LABELS[name]
        cases = " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(labels))
        return f"CASE ({key} + {n}) % {len(labels) + 1} {cases} END AS {name}"
    number = "BIGINT" if kind == "bigint" else "{money}"
    value = f"CAST(({key} * {7 + 2 * n}) % 1000 - 300 AS {number})"
    return f"CASE WHEN {key} % {11 + n} = 0 THEN NULL ELSE {value} END AS {name}"


def _full(table: str) -> str:
    if table not in FILL_KEYS:
        return BASE[table]
    key = FILL_KEYS[table]
    extra = [_filler(key, n, *item) for n, item in enumerate(FILLED[table].items())]
    return f"SELECT v.*, {', '.join(extra)}\nFROM ({BASE[table]}) v"


VIEWS = {table: _full(table) for table in BASE}

SPARK_DAYS = r"CAST(datediff(CAST(\1 AS DATE), DATE '\2') AS BIGINT)"
DUCKDB_DAYS = r"CAST(date_diff('day', DATE '\2', CAST(\1 AS DATE)) AS BIGINT)"
MONEY_EXACT = "DECIMAL(18,4)"


def dialect(sql: str, days: str, money: str) -> str:
    return re.sub(r"\{days:(\w+):([\d-]+)\}", days, sql).replace("{money}", money)


def spark_sql(sql: str, money: str = "DOUBLE") -> str:
    return dialect(sql, SPARK_DAYS, money)


def star_tables(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or STAR_TABLES}


def run_sql(spark: SparkSession, sf_dir: str, sql: str, money: str = "DOUBLE") -> DataFrame:
    """Run dialect-neutral SQL over the star tables of a directory."""
    text = spark_sql(sql, money)
    names = [n for n in STAR_TABLES if re.search(rf"\b{n}\b", text)]
    for name in names:
        text = re.sub(rf"\b{name}\b", "{" + name + "}", text)
    return spark.sql(text, **star_tables(spark, sf_dir, names))


def lending_tables(
    spark: SparkSession, sf_dir: str, exact: bool = False, names=None
) -> dict[str, DataFrame]:
    """The seven tables; ``exact`` carries money as DECIMAL instead of DOUBLE."""
    money = MONEY_EXACT if exact else "DOUBLE"
    return {n: run_sql(spark, sf_dir, VIEWS[n], money) for n in names or VIEWS}
